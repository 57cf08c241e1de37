"""The stages together, and each against what it promises."""

import random

import corpus_pipeline
from quillspark.llm import queries
from test_simhash import changed_pairs


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage = prose(70)
    clean = {i: prose(120) for i in range(160)}
    toxic = {200 + i: prose(60) for i in range(40)}
    for words in toxic.values():
        for _ in range(6):
            words[rng.randrange(60)] = rng.choice(["scum", "idiot", "moron"])
    texts = {i: " ".join(w) for i, w in (clean | toxic).items()}
    texts[300] = "the same line again and again here we go once more. " * 40
    texts[301] = texts[0]
    texts[302] = " ".join([*clean[1][:50], "changed", *clean[1][51:]])
    texts[303] = " ".join([*prose(80), *passage, *prose(80)])
    texts[304] = " ".join([*prose(80), *passage, *prose(80)])
    rows = [(i, t, "en", "src", len(t)) for i, t in texts.items()] + [(None, None, None, None, None), (400, "", "en", "src", 0)]
    write(spark, tmp_path, rows, [(i, 1, int(i >= 200)) for i in [*range(0, 160, 2), *range(200, 240, 2)]])
    sf = f"file://{tmp_path}"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    names = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{n}")
        docs = spark.read.parquet(f"{sf}/stage{n}")
        if name != "best_fit_packing":
            assert docs.columns == names
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    before = set(texts) | {None, 400}
    assert before - set(kept["toxicity"]) == set(toxic)
    assert set(kept["toxicity"]) - set(kept["quality_rules"]) == {300}
    assert set(kept["quality_rules"]) - set(kept["simhash_near_dedup"]) == {301, 302}
    last = kept["suffix_array_dedup"]
    assert set(last) == set(kept["simhash_near_dedup"]) and len(last[303].split()) == 230 and len(last[304].split()) == 160
    assert sum(r["n_tokens"] for r in docs.collect()) == sum(len((t or "").split()) for t in last.values())
    assert {d for r in docs.collect() for d in r["doc_ids"]} == {i for i, t in last.items() if t}
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_no_near_duplicate_gets_through(spark, tmp_path):
    """Pairs at the edge of the radius whose least certain bits are not those that differ."""
    one, other = changed_pairs(1500)
    texts = [side[i].decode() for i in (270, 754, 793, 857) for side in (one, other)]
    write(spark, tmp_path, [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)], [(0, 1, 0)])
    bins = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert {d for r in bins.collect() for d in r["doc_ids"]} == {0, 2, 4, 6}


def test_each_stage_reads_what_the_last_one_wrote(spark, tmp_path, monkeypatch):
    write(spark, tmp_path, [(i, f"text {i}", "en", "src", 6) for i in range(5)], [(0, 1, 0)])
    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs.where(f"doc_id <> {len(read)}")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    last = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert sorted(r["doc_id"] for r in last.collect()) == [0, 3, 4]
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:").rstrip("/").replace("//", "/")
    for files, name in ((read[1], "0_one"), (last.inputFiles(), "1_two")):
        assert files and all(shared in f and f"/{name}/" in f for f in files)


def test_odd_tables(spark, tmp_path):
    """Nulls everywhere, empty and long texts, repeated rows, clashing names, no rows."""
    rng = random.Random(3)
    words = [str(rng.randrange(10**8)) for _ in range(150_000)]
    rows = [(1, "short text", "en", "s", 10), (1, "short text", "en", "s", 10), (None, "no id at all", None, None, None), (2, None, None, None, None), (3, "", "", "", 0), (4, " \n ", "en", "s", 3), (5, " ".join(words), "en", "s", None), (6, " ".join(words[:60]) + " and more", "en", "s", 1)]
    more = [(f"{i}", i, None) for i in range(len(rows))]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, q_id int, part string"
    spark.createDataFrame([r + m for r, m in zip(rows, more)], names).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 1), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    sf = f"file://{tmp_path}/a"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/stage{n}")
        docs = spark.read.parquet(f"{sf}/stage{n}")
        if name == "suffix_array_dedup":
            last = {r["doc_id"]: r for r in docs.collect()}
            assert docs.count() == 7 and set(last) == {1, None, 2, 3, 4, 5, 6} and last[6]["text"].strip() == "and more" and last[6]["n_chars"] == len(last[6]["text"])
            assert last[5]["text"].split() == words and last[2]["text"] is None
    held = docs.collect()
    assert sum(r["n_tokens"] for r in held) == 2 + 4 + 150_000 + 2 and all(r["n_tokens"] <= 2048 for r in held)
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/b").count() == 0


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
