from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import chunkers


def window_model(text, size, overlap, most):
    text, out, start = text.strip(), [], 0
    while start < len(text) and len(out) < most:
        out.append(text[start : start + size])
        start += max(1, size - overlap)
    return out


def objects(spark, texts):
    rows = [(f"s{k}", "p", "t\x00itle", t, "2020-01-01", "") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "source_id string, project string, title string, full string, created string, updated string")


def test_fixed_windows(spark):
    texts = ["abcdefghij", "", None, "  ", "a\x00b", "åäö😀" * 5, "x" * 23]
    got = chunkers.chunk_rows(objects(spark, texts), "doc", 4, 1, 3).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["source_id"], r["chunk_idx"])):
        by.setdefault(r["source_id"], []).append(r["text"])
    assert by["s0"] == ["abcd", "defg", "ghij"]
    for k, t in enumerate(texts):
        assert by.get(f"s{k}", []) == window_model((t or "").replace("\x00", ""), 4, 1, 3)
    assert all(r["title"] == "title" and r["updated"] == "2020-01-01" and len(r["content_hash"]) == 16 for r in got)


def test_uncapped_tail(spark):
    got = chunkers.chunk_rows(objects(spark, ["abcdefghij"]), "doc", 4, 1, None).orderBy("chunk_idx").collect()
    assert [r["text"] for r in got] == ["abcd", "defg", "ghij", "j"]


def test_markdown():
    text = "# One\n" + "word " * 30 + "\n## Two ##\nbody\n# Three\nx"
    got = chunkers.markdown_chunks(text, 90, 10, 20)
    assert all(c.startswith("Heading: ") for c in got)
    assert any(c.startswith("Heading: One > Two\n\n") for c in got) and got[-1].startswith("Heading: Three")
    assert chunkers.markdown_chunks("", 90, 10) == []


def test_code_symbols_and_conservation():
    source = "import os\n\n\ndef first(a):\n    return a + 1\n\n\nclass Box:\n    def one(self):\n        return 1\n\n    def two(self):\n        return 2\n"
    got = chunkers.code_chunks(source, "a.py", None, 40, 10)
    assert {s for c in got for s in c[1]} >= {"first", "Box.one", "Box.two"}
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(c[5] for c in got)) == squeeze(source)
    long = "def f():\n" + "".join(f"    x{k} = {k}\n" for k in range(400))
    assert len(chunkers.code_chunks(long, "b.py", None, 700, 80)) > 1
    assert len(chunkers.code_chunks("def a():\n    pass\n\ndef b():\n    pass\n", "c.py", None, 700, 80)) == 1
    assert chunkers.code_chunks("x\n" * 100, "d.unknown", None, 40, 10)[0][0] == "text"
    assert chunkers.code_chunks("def broken(:\n", "e.py")[0][0] == "python"


@given(st.lists(st.text(alphabet="abc (){}:=\n", max_size=40), max_size=30), st.integers(10, 200))
def test_code_keeps_everything(lines, budget):
    source = "\n".join(lines)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(c[5] for c in chunkers.code_chunks(source, "x.txt", None, budget, 8))) == squeeze(source)


JS = """import x from "y";

// a } that doesn't count
function first(a) {
  return "{" + a;
}

class Box extends Base {
  one() {
    return `{${this.a}`;
  }

  async two(b, c) {
    if (b) { return c; }
    return 1;
  }
}

export const third = async (q) => {
  return q;
};
"""
RUST = """pub struct Point { x: i32 }

impl Point {
    pub fn new(x: i32) -> Self {
        Point { x }
    }
}

fn main() {
    let p = Point::new(1);
}
"""
C = """#include <a.h>
#define OPEN {
static int add(int a, char *b)
{
    return a; /* } */
}
int main(void) {
    while (1) { break; }
    return add(1, "}");
}
"""


def test_blocks_of_languages_with_braces():
    got = chunkers.code_chunks(JS, "a/b.ts", None, 60, 10)
    assert [s for c in got for s in c[1]] == ["first", "Box", "Box.one", "Box.two", "third"]
    assert "".join("".join(c[5].split()) for c in got) == "".join(JS.split())
    assert [c[2] for c in got if c[1] == ["first"]] == ["function"] and any(c[6].startswith("[a/b.ts] class Box") for c in got)
    assert {s for c in chunkers.code_chunks(RUST, "p.rs", None, 40, 5) for s in c[1]} == {"Point", "Point.new", "main"}
    assert {s for c in chunkers.code_chunks(C, "m.c", None, 30, 5) for s in c[1]} >= {"main"}
    long = "function f() {\n" + "".join(f"  x{k} = {k};\n" for k in range(400)) + "}\n"
    pieces = chunkers.code_chunks(long, "b.js", None, 700, 80)
    assert len(pieces) > 3 and all(len("".join(c[5].split())) <= 700 + 10 for c in pieces)
    assert len(chunkers.code_chunks("function a() {\n}\n\nfunction b() {\n}\n", "c.js", None, 700, 80)) == 1


@given(st.lists(st.text(alphabet="ab (){}\"'`/*;=\n", max_size=40), max_size=30), st.integers(10, 200))
def test_blocks_keep_everything(lines, budget):
    source = "\n".join(lines)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(c[5] for c in chunkers.code_chunks(source, "x.js", None, budget, 8))) == squeeze(source)


def test_query_terms(spark):
    q = spark.createDataFrame([("How do I find the Försörjningsstöd och snake_case_name document?",), ("search archive",), ("",), (None,)], "q string")
    rows = q.select(X.query_terms(F.col("q")).alias("t"), X.soft_terms(F.col("q")).alias("s")).collect()
    assert rows[0]["t"] == ["find", "försörjningsstöd", "och", "snake", "case", "name", "document"]
    assert rows[0]["s"] == ["försörjningsstöd", "snake", "case", "name", "document"]
    assert rows[1]["s"] == ["search", "archive"] and rows[2]["t"] == [] and rows[3]["s"] == []


def test_text_expressions(spark):
    row = spark.createDataFrame([("Ã¤", "ä", "Ã", "A  b\r\nTags: x", "From: Me <me@Mail.Example>\n", "a#b#0")], "a string, b string, c string, n string, m string, i string").select(
        X.latin1_repair(F.col("a")).alias("a"), X.latin1_repair(F.col("b")).alias("b"), X.latin1_repair(F.col("c")).alias("c"), X.note_key(F.col("n")).alias("n"), X.sender_domain(F.col("m")).alias("m"), X.object_key(F.col("i")).alias("i"),
        X.epoch_day(F.lit(1723500000000.0)).alias("e"), X.html_text(F.lit("<p>a &amp; b</p><script>x</script>")).alias("h"),
    ).first()
    assert tuple(row) == ("ä", "ä", "Ã", "A b", "mail.example", "a#b", "2024-08-12", "a & b")
