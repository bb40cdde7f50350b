from __future__ import annotations

import corpus_pipeline as C
import sentencepiece

from embertrail.llm.pieces import MODEL
from embertrail.llm.simhash import fingerprint
from tests.llm.test_lines import brute
from tests.llm.test_mixing import targets
from tests.llm.test_simhash import components


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = C.quality(spark, docs, small)
    texts = {r.doc_id: r.text for r in kept.collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").collect() if not r.quality}
    assert kept.columns == columns and len(bad & texts.keys()) <= 0.2 * len(bad) and len(texts) > 0.8 * (docs.count() - len(bad) * 3)

    lines = C.line_dedup(spark, kept, small)
    hashed = [(r.doc_id, r.text, r.h) for r in kept.selectExpr("doc_id", "text", "xxhash64(text) h").collect()]
    drop, want = brute(hashed), {}
    for d, t, h in hashed:
        gone = drop.get((False, d, h), ([],))[0]
        text = "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone)
        if not gone or text.strip():
            want[d] = text
    assert lines.columns == columns and {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect() if len(r.text) != len(texts[r.doc_id]))

    single = C.near_dedup(spark, lines, small)
    comp = components({d: fingerprint(t) for d, t in want.items()})
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(set(comp.values()))

    mixed = C.mixing(spark, single, small)
    rows = mixed.collect()
    sizes, taken = {}, {}
    for r in single.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    goal = targets(sizes)
    assert mixed.columns == columns and all(goal[s] * 0.75 <= taken.get(s, 0) <= goal[s] + 1e-6 for s in sizes)

    coded = C.encoding(spark, mixed, small).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = {r.doc_id: r.text for r in rows}
    assert len(coded) == len(rows) and all(list(r.ids) == lib.encode(text[r.doc_id]) for r in coded)


def test_run_is_the_stages_in_turn(spark, small):
    assert [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "encoding"]
    out = C.run(spark, small)
    assert out.columns == ["doc_id", "ids"] and out.count() > 0


def test_odd_rows_go_through_every_stage(spark, small):
    extra = ["_id", "_h", "_dropped", "h", "row", "id", "class", "dropped", "_copies", "_row", "key"]
    line = "A line that is long enough to be compared with others, number "
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "x " * 40_000), (5, f"{line}ten\nShort"), (5, f"{line}ten\nShort"), (6, f"{line}tin\nShort\nMore words here"), (None, "no id\nShort"), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(d, t, "en", "a" if i % 2 else None, len(t or ""), *extra) for i, (d, t) in enumerate(rows)], schema)
    for name, stage in C.STAGES:
        out, none = stage(spark, docs, small), stage(spark, docs.limit(0), small)
        assert none.count() == 0 and out.columns == none.columns, name
        if name == "encoding":
            assert sorted((r.doc_id or 0, len(r.ids) > 0) for r in out.collect()) == sorted((d or 0, bool(t)) for d, t in rows)
        else:
            got = out.collect()
            assert out.columns == docs.columns and all(r[c] == c for r in got for c in extra), name
    kept = {(r.doc_id or 0, r.text) for r in C.line_dedup(spark, docs, small).collect()}
    assert kept == {(1, None), (2, ""), (3, "\n\n"), (4, "x " * 40_000), (5, f"{line}ten\nShort"), (6, "More words here"), (0, "no id"), (0, None)}
    assert sorted(r.doc_id or 0 for r in C.near_dedup(spark, docs, small).collect())[:2] == [0, 0]
