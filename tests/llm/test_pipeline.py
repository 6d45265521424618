"""Each stage of the pipeline on its own input, against plain versions."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from skarn.llm.packing import Shard, cut_pieces, pack_documents
from skarn.llm.vocab import default_path
from test_decontamination import plain_leaks
from test_line_dedup import plain as plain_lines
from test_quality import plain as plain_counts
from test_simhash import plain_components, plain_print

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
            after = {r["doc_id"]: r for r in rows}
            # The line dedup leaves these few documents without copies of each other.
            assert len(after) == len(rows) and (set(after) <= set(before) if k == 2 else set(after) < set(before)), name
        if k == 0:
            for d, r in before.items():
                n, _, _, _, repeated = plain_counts(r["text"])
                assert not (d in after and (n < 20 or 100 * repeated > 30 * n))
            assert len(after) > 0.7 * len(before)
        if k == 1:
            gone = plain_lines(sorted((d, r["text"]) for d, r in before.items()))
            for d, r in before.items():
                left = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in set(gone.get(d, ())))
                assert (d in after) == bool(d not in gone or left.split()) and (d not in after or after[d]["text"] == left)
                assert d not in after or after[d]["n_chars"] == len(left)
        if k == 2:
            ids = sorted(before)
            names = plain_components([plain_print(before[d]["text"]) for d in ids])
            assert set(after) == {ids[i] for i, c in enumerate(names) if c == i}
        if k == 3:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            held = {d for d, _ in plain_leaks([(d, r["text"]) for d, r in before.items()], items)}
            assert set(after) == set(before) - held
        if k == 4:
            assert {r["doc_id"] for r in rows} == set(before)


def test_near_duplicates_of_whole_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    after = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER).collect()}
    ids = sorted(before)
    names = plain_components([plain_print(before[d]["text"]) for d in ids])
    assert after == {ids[i] for i, c in enumerate(names) if c == i} and len(after) < len(before)


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and set(rows[0].asDict()) >= {"doc_id", "piece", "sequence_id", "offset", "length"}


def check_packing(spark, docs, packed):
    library = Tokenizer.from_file(default_path())
    rows = {}
    for r in packed.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    total, places = 0, {}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        pieces = sorted(rows[r["doc_id"]], key=lambda p: p["piece"])
        assert [(p["piece"], p["start"], p["length"]) for p in pieces] == [(i, s, min(2048, len(ids) - s)) for i, s in enumerate(range(0, len(ids), 2048))]
        import zlib

        for p in pieces:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        total += len(ids)
    for parts in places.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    return len(places), -(-total // 2048)


def test_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sequences, least = check_packing(spark, docs, pack_documents(docs))
    assert sequences <= least + 1


def test_packing_edges(spark):
    long = "word " * 5000
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, long, 0), (4, "a b", 0), (5, "word " * 2047, 0)], "doc_id long, text string, row int")
    assert check_packing(spark, docs, pack_documents(docs)) == (4, 4)
    twice = pack_documents(docs.union(docs)).collect()
    assert len(twice) == 2 * cut_pieces(docs, default_path(), 2048).count()
    assert pack_documents(docs.limit(0)).count() == 0


def test_many_shards(spark, monkeypatch):
    from skarn.llm import packing

    monkeypatch.setattr(packing, "SHARD", 60)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sequences, least = check_packing(spark, docs, pack_documents(docs))
    assert sequences <= 1.02 * least


def test_pieces_that_fill_no_bin(spark, monkeypatch):
    from skarn.llm import packing

    monkeypatch.setattr(packing, "SHARD", 20)
    plain, calls = packing.written, []

    def written(df, purpose):
        calls.append(purpose)
        assert len(calls) < 60, "the levels do not end"
        return plain(df, purpose)

    monkeypatch.setattr(packing, "written", written)
    cases = [([1100] * 150, 150, 150), ([600] * 150, 50, 55), ([1] * 300, 1, 1), ([1025 + 7 * k for k in range(140)] + [300] * 10, 140, 145)]
    for lengths, least, most in cases:
        calls.clear()
        pieces = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
        rows, bins = packing.pack(pieces, 2048).collect(), {}
        assert sorted(r["row"] for r in rows) == list(range(len(lengths)))
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == bins.get(r["sequence_id"], 0)
            bins[r["sequence_id"]] = r["offset"] + lengths[r["row"]]
        assert max(bins.values()) <= 2048 and least <= len(bins) <= most


def test_crossover():
    rnd = np.random.default_rng(3)
    work = Shard(rnd.integers(100, 900, 200), 2048, 1)
    a, b = work.fresh(0.0), work.fresh(0.4)
    for _ in range(20):
        child = work.cross(a, b)
        assert work.fills(child).max() <= 2048 and len(child) == 200 and child.min() >= 0
        b = child
    start = [work.fresh(0.5) for _ in range(4)]
    assert work.cost(work.evolve(start, 30)) <= min(map(work.cost, start))
