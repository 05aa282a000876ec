"""Literal cases and seeded random texts against small plain-Python rules."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkprint.functions import cleaning as cl
from inkprint.functions import style as st
from inkprint.functions import tokens as tk
from inkprint.functions import trees as tr
from inkprint.operators import grams as gr
from inkprint.operators import vectors as ve
from inkprint.operators import vocabulary as vo


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pid bigint, code string")


def column(spark, values, expression):
    rows = texts(spark, values).select("pid", expression.alias("x")).orderBy("pid").collect()
    return [r["x"] for r in rows]


def random_texts(seed, count=40):
    draw = random.Random(seed)
    letters = "ab /*\n\"'{}[]()+=<>_9Z;#\t" + "é\U0001d4b3"
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 80))) for _ in range(count)]


@pytest.mark.parametrize("n", [1, 2, 6])
def test_char_ngrams(spark, n):
    values = random_texts(n) + ["", "a", "a\U0001d4b3b", "\U0001d4b3" * 7, "a\r\nb\rc"]
    want = [[v[i : i + n] for i in range(len(v) - n + 1)] for v in values]
    assert column(spark, values, tk.char_ngrams(F.col("code"), n)) == want


def test_byte_ngrams(spark):
    values = random_texts(9) + ["", "é"]
    got = column(spark, values, F.transform(tk.byte_ngrams(F.encode("code", "utf-8"), 3), lambda g: F.hex(tk.gram_bytes(g))))
    raw = [v.encode() for v in values]
    assert got == [[b[i : i + 3].hex().upper() for i in range(len(b) - 2)] for b in raw]


def test_tokenisers(spark):
    values = random_texts(3) + ["It's a_b, x\ty 12", "Ünï cödé", ""]
    assert column(spark, values, tk.words(F.col("code"))) == [re.findall(r"\b\w\w+\b", v.lower()) for v in values]
    table = str.maketrans({c: " " for c in tk.SEQUENCE_FILTERS})
    want = [[w for w in v.lower().translate(table).split(" ") if w] for v in values]
    assert column(spark, values, tk.sequence_words(F.col("code"))) == want
    assert column(spark, values, tk.chars(F.col("code"))) == [list(v.lower()) for v in values]
    want = [list(re.sub(r"\s\s+", " ", v.lower())) for v in values]
    assert column(spark, values, tk.collapsed_chars(F.col("code"))) == want


def test_padding_and_encoding(spark):
    rows = spark.createDataFrame([(0, []), (1, [5, 6]), (2, [1, 2, 3, 4, 5])], "pid bigint, ids array<int>")
    got = [r[0] for r in rows.orderBy("pid").select(tk.pad_left(F.col("ids"), 3)).collect()]
    assert got == [[0, 0, 0], [0, 5, 6], [3, 4, 5]]
    got = [r[0].asDict() for r in rows.orderBy("pid").select(tk.encode_fixed(F.col("ids"), 5)).collect()]
    assert [g["input_ids"] for g in got] == [[1, 2, 0, 0, 0], [1, 5, 6, 2, 0], [1, 1, 2, 3, 2]]
    assert [g["attention_mask"] for g in got] == [[1, 1, 0, 0, 0], [1, 1, 1, 1, 0], [1] * 5]
    assert all(g["token_type_ids"] == [0] * 5 for g in got)


def test_comments(spark):
    values = ["x /* a */ y;\n/* b */\n//c\nint k; // d", "/* a */ b\n c */\nd", "//x\ny", '"http://a"'] + random_texts(5)

    def plain(v):
        v = re.sub(r"(?s)/\*.*?\*/\n", "", v)
        return re.sub(r"//.*", "", re.sub(r"\n\s*//.*", "", v))

    assert column(spark, values, cl.strip_comments(F.col("code"))) == [plain(v) for v in values]
    stats = column(spark, ["int a; // x\n//y\n/* z */\nb"], cl.comment_stats(F.col("code")))[0]
    assert (stats["ts1"], stats["ts2"], stats["fs1"]) == (0, 3 / 2, 3 / 4)


def test_literals_and_keywords(spark):
    values = ["'\"'", '"it\'s"', 'a "b" c', "'x\n'"] + random_texts(6)
    want = [re.sub("[\"'].*?[\"']", cl.PLACEHOLDER, v) for v in values]
    assert column(spark, values, cl.mask_literals(F.col("code"))) == want
    values = ["for forx x_for int8_t;char16_t charx", "#include <a>\ntypedef int b;\nreturn éfor"]

    def plain(v):
        v = re.sub(r"\btypedef\b.*", "", re.sub(r"#\b\w+\b.*", "", v))
        for word in cl.KEYWORDS:
            v = re.sub(rf"\b{word}\b", "", v)
        return v

    assert column(spark, values, cl.strip_directives_keywords(F.col("code"))) == [plain(v) for v in values]
    assert column(spark, ["a\r\nb\rc\n"], cl.universal_newlines(F.col("code"))) == ["a\nb\nc\n"]
    assert column(spark, ["", "a", "a\n"], cl.count_lines(F.col("code"))) == [1, 1, 2]


MACROS = """#include <string>
#define OPEN    \\
    begin(log); \\
    mark(log);
#define twice(q) ((q) + (q))
#define join2(l,r) l ## r
#define SAY(...) write(__VA_ARGS__)
#define SIZE 40
#define SIZE 41
#define gap( a , b ) b - a
void run() { OPEN x = twice(SIZE); join2(p,q); join2 (h(3),4); SAY(SIZE); SIZES; gap(1, 2) }
"""


def test_macros(spark):
    bad = "#define + 2\nint x;"
    short = "#define two(a,b) a b\ntwo(1);"
    got = column(spark, [MACROS, bad, short], cl.expand_macros("code"))
    assert got[0]["error"] is None
    text = got[0]["code"]
    assert "#define" not in text and text.startswith("#include <string>\n")
    assert "{ begin(log); mark(log); x = ((41) + (41)); p ## q; join2 (h(3),4); SAY(41); SIZES; 2 - 1 }" in text
    assert got[1]["code"] is None and "bad definition" in got[1]["error"]
    assert got[2]["code"] is None and "arguments expected" in got[2]["error"]


# ------------------------------------------------------------------ style

PROGRAM = """#include <iostream>
#define N 10
// head
int sum_all (int a[], string s) {
  int my_x1 = 0;

  for (int i = 0; i < N; i++) my_x1 += a[i][0]; // add
  while(true) { if (my_x1 > 2) {
      break; } }
  Big = Big + 1; go to
  return 0;
}"""


def style_of(spark, code, pre=None):
    rows = spark.createDataFrame([(0, code, code if pre is None else pre)], "pid bigint, code string, code_pre string")
    return st.style_columns(rows).first().asDict()


def test_style_values(spark):
    got = style_of(spark, PROGRAM)
    lines = PROGRAM.split("\n")
    assert got["tl3"] == pytest.approx(1 / len(lines))
    assert got["tl4"] == pytest.approx(sum(len(x) - len(x.lstrip()) for x in lines) / len(lines))
    assert got["tr1"] == pytest.approx(len(PROGRAM) / len(lines))
    assert (got["ts1"], got["ts2"], got["fs1"]) == (0, pytest.approx(2 / 11), pytest.approx(2 / 12))
    assert (got["tl2"], got["ts4"], got["ts22"], got["fs8"], got["fs5"], got["fs6"]) == (1, 0, 1, 1, 1, 0)
    assert (got["ts17"], got["ts18"], got["ts19"]) == (1, 1, 1)
    assert got["fs3"] == pytest.approx(2 / 11)
    assert (got["fl2"], got["fl3"]) == (7, 1)
    assert got["fs7"] == pytest.approx(1 / 2)
    assert all(got[name] == 0 for name in st.CONSTANT_ZERO)
    assert set(got) - {"pid", "code"} == set(st.STYLE_NAMES) and len(st.STYLE_NAMES) == 36


@pytest.mark.parametrize(
    "code, two, formula",
    [
        ("a[i]", 0, 0),
        ("a[b[i]][j+1]", 1, 1),
        ("a[i][j]", 1, 0),
        ("a[i][j][k]", 0, 0),
        ("a[i] [j]", 1, 0),
        ("a[i] + b[j]", 0, 0),
        ("a[ [i]", 0, 0),
        ("a[i\n+1]", 0, 0),
        ("a[f(i)]", 0, 0),
        ("]a[i-1]", 0, 1),
        ("", 0, 0),
    ],
)
def test_brackets(spark, code, two, formula):
    got = style_of(spark, code or " ")
    assert (got["fs5"], got["fs6"]) == (two, formula)


def test_braces(spark):
    assert style_of(spark, "if (x) {")["tl2"] == 1
    assert style_of(spark, "if (x)\n{")["tl2"] == 0


def test_lexical_vector_is_136_wide(spark):
    rows = spark.createDataFrame([(0, PROGRAM, PROGRAM)], "pid bigint, code string, code_pre string")
    vector = st.lexical_vector(rows).first()["features"]
    assert len(vector) == 136
    assert vector[36:] == [PROGRAM.count(c) for c in st.PRINTABLE]


# ------------------------------------------------------------------ trees


def plain_paths(tree, n):
    """Grams of a well-formed tree by recursive descent."""
    out, path, text = [], [], ""
    for c in tree:
        if c == "{":
            path.append(text)
            if len(path) >= n:
                out.append(":".join(path[-n:]))
            text = ""
        elif c == "}":
            path.pop()
            text = ""
        else:
            text += c
    return out


TREE = "0 0{2 1{3 3{}4 1{8 2{}8 2{9 9{}}}}5 1{7 7{6 6{6 6{}}}7 7{}}2 1{}}"


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_tree_paths(spark, n):
    rows = spark.createDataFrame([(0, TREE)], "pid bigint, tree string")
    got = rows.select(tr.tree_ngrams(F.col("tree"), n).alias("t")).select("t.*").first()
    assert got["error"] is None and Counter(got["grams"]) == Counter(plain_paths(TREE, n))


def test_trees_against_a_walk(spark):
    """Random brace text, unbalanced too: levels, paths and errors."""
    draw = random.Random(6)
    texts_ = ["".join(draw.choice(["a", "bc", "{", "{", "}", "d e"]) for _ in range(draw.randrange(40))) for _ in range(150)] + ["", "{", "}}"]
    rows = spark.createDataFrame(list(enumerate(texts_)), "pid bigint, tree string")
    got = rows.select("pid", tr.nodes(F.col("tree")).alias("n"), *[tr.tree_ngrams(F.col("tree"), n).alias(f"p{n}") for n in (2, 3)]).collect()
    for r in got:
        level, latest, nodes, grams, bad = 0, {}, [], {2: [], 3: []}, {2: False, 3: False}
        for text, brace in re.findall(r"([^{}]*)([{}])", texts_[r.pid]):
            if text:
                nodes.append((level, text))
                latest[level] = text
                for n in (2, 3):
                    if level >= n - 1:
                        chain = [latest.get(level - up) for up in range(n - 1, -1, -1)]
                        bad[n] = bad[n] or None in chain
                        grams[n].append(":".join(c or "" for c in chain))
            level += 1 if brace == "{" else -1
        assert [tuple(x) for x in r.n] == nodes
        for n in (2, 3):
            found = r[f"p{n}"]
            assert (found.grams, found.error is not None) == (None if bad[n] else grams[n], bad[n])


def test_tree_edges(spark):
    rows = spark.createDataFrame([(0, "b}c{d{}}tail"), (1, "{b{}}"), (2, "a{b{}}{c{}}")], "pid bigint, tree string")
    ones = [r[0] for r in rows.orderBy("pid").select(tr.tree_ngrams(F.col("tree"), 1)["grams"]).collect()]
    assert ones == [["b", "c", "d"], ["b"], ["a", "b", "c"]]
    twos = [r[0] for r in rows.orderBy("pid").select(tr.tree_ngrams(F.col("tree"), 2)).collect()]
    assert twos[1]["grams"] is None and "unnamed ancestor" in twos[1]["error"]
    assert twos[2]["grams"] == ["a:b", "a:c"]  # the unnamed level still shows its last text
    none = rows.select(tr.tree_ngrams(F.col("tree"), 0)["grams"].alias("g")).first()
    assert none["g"] == []
    heads = spark.createDataFrame([("1 2:3 4",)], "g string").select(tk.head(F.col("g"))).first()[0]
    assert heads == "2:4"


# ------------------------------------------------------------------ vocabularies


def token_rows(spark, lists):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "pid bigint, tokens array<string>")


def test_vocabulary_ties_go_to_the_first_seen(spark):
    rows = token_rows(spark, [["z", "b", "b", "a"], ["a", "z", "q"], ["q"], []])
    for shuffled in (rows, rows.repartition(3, "tokens")):
        got = [r["gram"] for r in vo.fit_vocabulary(shuffled, 3).orderBy("idx").collect()]
        assert got == ["z", "b", "a"]
        assert [r["gram"] for r in vo.fit_vocabulary(shuffled, 0).orderBy("idx").collect()] == ["z", "b", "a", "q"]
    stats = {r["gram"]: (r["cnt"], r["df"]) for r in vo.term_stats(rows).collect()}
    assert stats == {"z": (2, 2), "b": (2, 1), "a": (2, 2), "q": (2, 2)}


def test_tree_vocabulary_limits(spark):
    rows = token_rows(spark, [["a", "a", "b"]])
    assert vo.fit_tree_vocabulary(rows, 0).count() == 0
    with pytest.raises(ValueError):
        vo.fit_tree_vocabulary(rows, -1)


def test_vectors_and_scaling(spark):
    rows = token_rows(spark, [["a", "a", "b", "x"], ["b"], []])
    vocabulary = vo.fit_vocabulary(rows.filter("pid < 2"), 2)
    cells = {(r["pid"], r["idx"]): r["value"] for r in ve.count(rows, vocabulary).collect()}
    assert cells == {(0, 0): 2.0, (0, 1): 1.0, (1, 1): 1.0}
    assert {tuple(r) for r in ve.binary(rows, vocabulary).collect()} == {(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0)}
    train = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (0, 1, 2.0), (1, 1, 4.0)], "pid bigint, idx bigint, value double")
    model = ve.minmax_fit(train, 2)
    dev = spark.createDataFrame([(7, 0, 3.0)], "pid bigint, idx bigint, value double")
    pids = spark.createDataFrame([(7,)], "pid bigint")
    got = {r["idx"]: r["value"] for r in ve.minmax_transform(dev, model, pids).collect()}
    assert got == {0: 2.0, 1: -1.0}  # a constant column loses its minimum; a missing cell is a zero
    assert [r["idx"] for r in ve.varying(train, 2).collect()] == [1]


def test_counts_do_not_depend_on_partitioning(spark):
    values = random_texts(11)
    rows = gr.with_tokens(texts(spark, values), tk.char_ngrams(F.col("code"), 2))
    want = sorted(map(tuple, gr.counts(rows).collect()))
    again = gr.with_tokens(texts(spark, values).repartition(5), tk.char_ngrams(F.col("code"), 2))
    assert sorted(map(tuple, gr.counts(again).collect())) == want
    totals = Counter()
    for pid, _, cnt, _ in want:
        totals[pid] += cnt
    assert all(totals[i] == max(0, len(v) - 1) for i, v in enumerate(values))
