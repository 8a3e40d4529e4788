"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import base64
import random
from collections import Counter

import corpus_pipeline
from kvspark.llm import mixing
from kvspark.llm.common import cut
from kvspark.llm.queries import rank_file

from .test_text_operators import SCHEMA, near_copies, plain_components, plain_lines, sha


def test_stages(spark, tmp_path):
    import tiktoken

    random.seed(2)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t, *_ in near_copies(3, n=80)]
    bad = ["vilest", "nastyish", "awfulness"]
    rows += [(100 + i, " ".join(random.choice(bad) if random.random() < 0.2 else f"w{random.randint(0, 300)}" for _ in range(60)), "en", "s1", 0) for i in range(60)]
    rows += [(200 + i, "A line that many share\n" + " ".join(f"w{random.randint(0, 300)}" for _ in range(40)), "en", None, 0) for i in range(20)]
    rows += [(300, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(100 <= i < 160)) for i, *_ in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "jaccard_join", "mixing", "bpe"]
    step = lambda name, frame: cut(stages[name](spark, frame, str(tmp_path)))
    as_rows = lambda frame: [tuple(r) for r in frame.collect()]

    calm = step("toxicity", docs)
    assert sorted(as_rows(calm)) == sorted(r for r in rows if not 100 <= r[0] < 160)
    lines = step("line_dedup", calm)
    assert lines.columns == docs.columns
    assert Counter((i, t) for i, t, *_ in as_rows(lines)) == Counter({(i, t): n for (i, _, _, t), n in plain_lines(as_rows(calm)).items()})
    apart = step("jaccard_join", lines)
    roots = {i: c for (i, _, c) in plain_components(as_rows(lines), 5, 80)}
    assert sorted(as_rows(apart)) == sorted(r for r in as_rows(lines) if roots[r[0]] == r[0]) and apart.count() < lines.count()
    mixed = step("mixing", apart)
    times = {r["doc_id"]: max(1, int(r["taken"] / r["size"] + 0.5)) for r in mixing.mix(apart).collect() if r["taken"]}
    assert Counter(i for i, *_ in as_rows(mixed)) == Counter(times) and mixed.columns == docs.columns
    tokens = step("bpe", mixed)
    ranks, pattern = rank_file()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in tokens.collect())
    assert got == Counter((i, len(e := plain.encode_ordinary(t)), tuple(e), sha(t)) for i, t, *_ in as_rows(mixed))


def test_odd_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, a very long text, clashing columns and an empty table through all stages."""
    from pyspark.sql import functions as F

    rows = [(None, "a row without id"), (None, "another row without id"), (1, None), (2, ""), (3, "the same text of five words twice"), (3, "the same text of five words twice"), (4, "the same text of five words twice"), (5, "long " * 50_000)]
    clash = {c: F.lit("x") for c in ("_id", "_row", "_gone", "_own", "_taken", "_copy", "size", "taken", "component_id", "kept")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")} | clash)
    for folder, frame in (("full", docs), ("none", docs.limit(0))):
        path = str(tmp_path / folder)
        frame.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(3, 0), (5, 1)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = cut(stage(spark, now, f"{tmp_path}/full"))
        assert now.columns == docs.columns or name == "bpe"
        if name == "jaccard_join":
            assert Counter(r["doc_id"] for r in now.collect()) == Counter([None, None, 1, 2, 3, 3, 4, 5])  # the fourth has lost its only line
    assert {r["doc_id"] for r in now.collect()} == {None, 3, 5}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
