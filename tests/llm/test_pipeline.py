import corpus_pipeline
from heliograph.llm import registry
from tests.llm.helpers import rows

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(rows(), docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, odd, docs.limit(0)):
            out = stage(spark, given, SF)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            n = out.count()
            assert n <= 3 * given.count()


def test_stages_keep_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["score", "accepted", "lang_pred", "cross_entropy", "_text", "_mark", "_doc", "_key", "_cuts", "_shard", "_0", "_7", "a.b", "c`d", "row", "key", "shard", "size", "n", "mark", "node", "first", "copies"]
    more = docs.select("*", *(F.concat(F.lit(f"{name} "), F.col("doc_id")).alias(name) for name in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, SF)
        assert sorted(out.columns) == sorted(more.columns), name
        kept = sorted(tuple(r[c] for c in docs.columns) for r in out.collect())
        assert kept and kept == sorted(tuple(r[c] for c in docs.columns) for r in stage(spark, docs, SF).collect()), name
        for r in out.collect():
            assert all(r[c] == f"{c} {r.doc_id}" for c in names if (name, c) != ("sharding", "shard")), name


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(r.shard for r in out.select("shard").distinct().collect()) == set(range(8))


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))


def brute_run(docs, bench, models):
    """The five stages by their definitions, over Python lists; rows as in documents."""
    import duckdb
    import pandas as pd

    from heliograph.llm import decontaminate as D
    from heliograph.llm import mixing

    names, _, _, accepted = models.predict([None if t is None else t.encode() for _, t, *_ in docs])
    docs = [(d, t, n, *rest) for (d, t, _, *rest), n, ok in zip(docs, names, accepted, strict=True) if ok]
    sets = []
    for _, t, *_ in docs:
        w = "".join(c.lower() if c < "\x80" else c for c in t).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for i, (d, *_) in enumerate(docs):
        best[group[i]] = min(best.get(group[i], i), i, key=lambda k: docs[k][0])
    docs = [docs[i] for i in sorted(best.values())]

    def holds(text, item):
        own = D.words(item.encode())
        return own and sum(n for *_, n in D.tiles(own, D.words(text.encode()), min(D.TILE, len(own)))) >= D.COVERAGE * len(own)

    docs = [row for row in docs if not any(holds(row[1], item) for _, item in bench)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(d, t, s) for d, t, _, s, _ in docs], columns=["doc_id", "text", "source"]))
    copies = {d: taken // size if size else 0 for d, size, _, _, taken in con.execute(mixing.OP9_SQL).fetchall()}
    docs = sorted(row for row in docs for _ in range(copies[row[0]]))
    total, before, cuts = sum(len(t.encode()) + 1 for _, t, *_ in docs), 0, {}
    for d, t, *_ in docs:
        cuts.setdefault(before * 8 // total, d)
        before += len(t.encode()) + 1
    return [(*row, sum(c <= row[0] for c in cuts.values()) - 1) for row in docs]


def test_run_equals_brute_force(spark, tmp_path):
    import random

    from heliograph.llm import language

    rng = random.Random(12)
    known = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and n_chars > 400").orderBy("doc_id").limit(70).collect()
    bench = [(i, " ".join(rng.choice("ash beech cedar date elm fir gum hazel ivy jute".split()) for _ in range(rng.choice([3, 12, 30])))) for i in range(12)]
    data = []
    for k, r in enumerate(known):
        data.append((10 * k, r.text, r.lang, r.source, r.n_chars))
        words = r.text.split(" ")
        if k % 3 == 0:
            data.append((10 * k + 1, r.text, r.lang, r.source, 1))
        if k % 4 == 0:  # some are near copies, some just aren't
            for at in rng.sample(range(len(words)), max(1, len(words) // rng.choice([25, 60, 200]))):
                words[at] = "changed"
            data.append((10 * k + 2, " ".join(words), r.lang, "other", 2))
        if k % 5 == 0:
            item = rng.choice(bench)[1].split()
            cut = rng.randint(0, len(item))
            data.append((10 * k + 3, " ".join([*r.text.split()[: 40 + k], *item[cut:], *item[:cut]]), r.lang, r.source, 3))
        if k % 9 == 0:
            data.append((10 * k + 4, "Ωμέγα ψυχή λόγος " * 30, r.lang, r.source, 4))
            data.append((10 * k + 5, None if k % 2 else "12 34", r.lang, r.source, None))
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stored = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*stored.columns, "shard"]
    expected = brute_run([tuple(r) for r in stored.orderBy("doc_id").collect()], bench, language.fit(stored))
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert 30 < len({r[0] for r in expected}) < len(data) - 20
