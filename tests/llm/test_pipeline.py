from collections import Counter

import corpus_pipeline as P
from cellarbook.llm import pii, quality
from llm.test_mixing import by_hand as targets_by_hand
from llm.test_ngram_join import by_hand as groups_by_hand
from llm.test_pii import strict_by_hand
from llm.test_tokens_packing import whole

FOLDER = "/root/testdata/sf0.01"


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def test_stages_one_by_one(spark, tmp_path):
    """Each stage against a plain version of itself, on all that the stage before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, rows_of(docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for number, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        after = rows_of(docs)
        if number < 4:
            assert docs.columns == columns
        if number == 0:
            kept = {r["doc_id"] for r in after}
            good = [d["doc_id"] for d in before if labels.get(d["doc_id"]) == 1]
            bad = [d["doc_id"] for d in before if labels.get(d["doc_id"]) == 0]
            assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)
            known = spark.read.parquet(f"{FOLDER}/labels.parquet").where(f"NOT {P.HELD_OUT}").selectExpr("doc_id", "quality AS label")
            scored = quality.score(spark.read.parquet(f"{FOLDER}/documents.parquet"), quality.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), known))
            assert kept == {r.doc_id for r in scored.collect() if r.score >= 0.5}
        if number == 1:
            want = groups_by_hand([(d["doc_id"], d["text"]) for d in before], 5, 80)
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in want.items() if i == c)
            assert len(after) < len(before)
        if number == 2:
            texts, changed = {r["doc_id"]: r["text"] for r in after}, 0
            for d in before:
                spans = strict_by_hand(d["text"] or "")
                changed += bool(spans)
                assert (texts[d["doc_id"]] == d["text"]) == (not spans)
                assert not strict_by_hand(texts[d["doc_id"]] or "")
            assert changed > 5 and len(after) == len(before)
        if number == 3:
            size = {d["doc_id"]: len((d["text"] or "").split()) for d in before}
            source = {d["doc_id"]: d["source"] for d in before}
            sizes, taken = Counter(), Counter()
            for i, n in size.items():
                sizes[source[i]] += n
            for r in after:
                taken[source[r["doc_id"]]] += size[r["doc_id"]]
            for s, t in targets_by_hand(sizes).items():
                assert abs(taken[s] - t) <= 0.01 * t
            assert max(Counter(r["doc_id"] for r in after).values()) <= 3
        if number == 4:
            once = {d["doc_id"]: d["text"] for d in before}
            ids = dict(zip(once, whole("byte_bpe_50k.json", list(once.values()), 1), strict=True))
            copies, pieces = Counter(d["doc_id"] for d in before), docs.collect()
            assert sum(r.length for r in pieces) == sum(len(ids[i]) * c for i, c in copies.items())
            single = {i: x for i, x in ids.items() if copies[i] == 1}
            assert {r.doc_id for r in pieces} == set(ids) and all(r.doc_tokens == len(ids[r.doc_id]) for r in pieces)
            assert sum(r.length for r in pieces if r.doc_id in single) == sum(map(len, single.values()))
        before = after


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (None, "", "en", "a", 0), (5, "same words here " * 9, "en", "a", 144)]
    rows += [(6, "same words here " * 9, "en", None, 144), (7, "call +1 (988) 555-2485", "", "b", 22), (7, "call +1 (988) 555-2485", "", "b", 22), (8, "w " * 40_000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    grouped = P.one_of_each_group(spark, docs, FOLDER)
    assert sorted(((r.doc_id, r.text and r.text[:4]) for r in grouped.collect()), key=str) == sorted(
        [(1, None), (None, ""), (None, ""), (5, "same"), (7, "call"), (8, "w w ")], key=str
    )
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
        stage(spark, docs, FOLDER).collect()


def test_redaction_model_is_shared_by_operator_and_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    again = pii.redact(docs, pii.fit(docs)).orderBy("doc_id").collect()
    assert P.without_personal_data(spark, docs, FOLDER).orderBy("doc_id").collect() == again


def test_run_returns_pieces(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100
