"""The pipeline, stage by stage, against plain versions on the small tables."""

from test_training_data import lower, pieces_of, check_packing, plain_contamination, plain_line_dedup, shingles

import corpus_pipeline
from webloom.llm import byte_cnn
from webloom.session import checkpointed


def kept(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "pack"]
    columns, before = docs.columns, kept(docs)

    placed = checkpointed(stages["language_id"](spark, docs, sf_dir))
    model = byte_cnn.trained(docs.where(~byte_cnn.held_out()))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in byte_cnn.predict(docs, model).collect()}
    assert placed.columns == columns and kept(placed) == {d: t for d, t in before.items() if found[d][0] != "und" and found[d][1] >= 0.35}
    assert len(kept(placed)) >= 0.99 * len(before)

    lines = checkpointed(stages["line_dedup"](spark, placed, sf_dir))
    want = {d: t.decode() for d, t, gone in plain_line_dedup(list(kept(placed).items())) if t or not gone}
    assert lines.columns == columns and kept(lines) == want
    assert lines.where("n_chars <> length(text)").count() == 0

    single = checkpointed(stages["ngram_jaccard"](spark, lines, sf_dir))
    rows, sets = sorted(want.items()), {d: shingles(lower(t), 5) for d, t in want.items()}
    root = {d: d for d in want}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, _) in enumerate(rows):
        for b, _ in rows[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    want = {d: t for d, t in want.items() if top(d) == d}
    assert single.columns == columns and kept(single) == want

    clean = checkpointed(stages["decontaminate"](spark, single, sf_dir))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {r[0] for r in plain_contamination(want.items(), items) if r[-1]}
    want = {d: t for d, t in want.items() if d not in hit}
    assert clean.columns == columns and kept(clean) == want

    packed = stages["pack"](spark, clean, sf_dir).collect()
    used, total = check_packing(packed, pieces_of(want.items(), 2048), 2048)
    assert used <= 1.02 * -(-total // 2048) + 1


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
