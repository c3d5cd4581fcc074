"""The pipeline's stages on a small corpus: what must go goes, clean documents stay."""

import random

import corpus_pipeline
from tests_prose import prose  # noqa: I001


def test_stages(spark, tmp_path):
    r = random.Random(3)
    item = prose(15, 999)
    rows, labels = [], []
    for i in range(160):
        text, good = prose(50, i), 1
        if i % 4 == 1:
            text, good = text.upper().replace(" ", "!! "), 0
        labels += [(i, good, int(i % 8 == 3))] if i < 120 else []
        if i % 8 == 3:
            text = text.replace(text.split()[r.randrange(50)], "wretch", 1)
        rows.append([i, text, "en", "s", len(text)])
    clean = [x for x in rows if x[0] % 4 in (0, 2)]
    clean[5][1] = clean[4][1]
    clean[7][1] = clean[7][1] + " " + item
    clean[9][1] = clean[9][1] + " mail bob.12@mail8.example.com"
    rows += [[500, None, "en", "s", None], [501, "", None, None, 0]]
    d = str(tmp_path)
    spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if name != "tokens":
            assert out.columns == columns
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        seen.append({x["doc_id"] for x in docs.select("doc_id").collect()})
    want = {x[0] for x in clean}
    assert len(want & seen[0]) >= len(want) - 1 and not {x[0] for x in rows if x[0] % 4 == 1 and x[0] < 500} & seen[0]
    assert len({x[0] for x in rows if x[0] % 8 == 3} & seen[0]) <= 1
    assert seen[0] - seen[1] == {clean[5][0]}
    assert seen[1] - seen[2] == {clean[7][0]}
    assert seen[2] == seen[3] == seen[4]
    redacted = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{d}/3").collect()}
    assert redacted[clean[9][0]].endswith(" mail [EMAIL]")
    assert all(len(x["ids"]) == x["n_tokens"] for x in docs.collect())
