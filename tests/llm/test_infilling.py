"""Fill-in-middle against a plain version by regular expression, and the round trip."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import infilling

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text, rate=50):
    text, digits = text or "", hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    if not text or any(x in text for x in infilling.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x1c aé𝒳<PSM>", max_size=40))
def test_units(text):
    units = UNIT.findall(text)
    u = infilling.Units(text)
    assert u.count == len(units) and u.marked == any(x in text for x in infilling.MARKS)
    assert [u.end(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def check(df, **more):
    made = infilling.fill_in_middle(df, **more)
    got = made.withColumn("text", infilling.restored(made["output"], made["form"])).collect()
    want = [(r["doc_id"], *plain(r["doc_id"], r["text"], **more)) for r in df.collect()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:-1]) for r in got)
    assert sorted(repr((r["doc_id"], r["text"] or "")) for r in df.collect()) == sorted(repr((r["doc_id"], r["text"])) for r in got)
    return [r["form"] for r in got]


def test_documents(docs):
    assert set(check(docs)) == {"plain", "psm", "spm"}


def test_edges(spark, edge, empty):
    check(edge, rate=100)
    assert infilling.fill_in_middle(empty).collect() == []
    big = 2**60
    odd = ["a<P>b", "a <S", "<", "P> <", " \n ", " a ", " x y", "a\x00b \x1c c"]
    rows = [(None, "one two three"), (big + 1, "x y z"), (big + 3, "x y z")] + list(enumerate(odd * 20))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rate=100)


def test_query(spark, docs):
    rows = {r["doc_id"]: r for r in infilling.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()}
    for d in docs.collect():
        n, form, p, m, out = plain(d["doc_id"], d["text"])
        r = rows[d["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
