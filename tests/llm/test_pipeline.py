import collections
import random

import corpus_pipeline
from quillon.llm import queries
from tests.llm.fixtures import prose
from tests.llm.test_learned_operators import junk
from tests.llm.test_text_operators import WORD, join_model, strip_model


def folder(spark, path):
    rng = random.Random(8)
    texts = [junk(rng, 80) if k % 5 == 0 else prose(rng, rng.randrange(60, 150)) for k in range(120)]
    passage = prose(rng, 55)
    for k in (1, 2, 3):
        texts[k] += " " + passage
    texts += [texts[6], texts[7] + " more"]
    data = [(k, t, "en", "ab"[k % 2], len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return data


def test_stages_against_models(spark, tmp_path):
    data = folder(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "mixing", "packing"]
    good = stages["quality_classifier"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    kept = sorted(map(tuple, good.collect()))
    assert kept == sorted(r for r in data if r[0] % 5 != 0 or r[0] >= 120 and "%%%" not in r[1] and "###" not in r[1])
    one = stages["ngram_jaccard_join"](spark, good, str(tmp_path))
    classes = {c for (_, c, _) in join_model(kept)}
    left = sorted(map(tuple, one.collect()))
    assert [r[0] for r in left] == sorted(classes)
    cut = stages["substring_dedup"](spark, one, str(tmp_path))
    assert cut.columns == docs.columns
    removed = {k: n for (k, _, n, _) in strip_model(left)}
    out = {r.doc_id: r for r in cut.collect()}
    for r in left:
        words = len(WORD.findall(r[1])) - removed[r[0]]
        assert (r[0] in out) == (words > 0)
        if words:
            assert len(WORD.findall(out[r[0]].text)) == words and out[r[0]].n_chars == len(out[r[0]].text)
    assert sum(n > 0 for n in removed.values()) == 3
    mixed = stages["mixing"](spark, cut, str(tmp_path))
    assert mixed.columns == docs.columns
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(out) and max(times.values()) <= 2
    packed = stages["packing"](spark, mixed, str(tmp_path)).collect()
    assert collections.Counter(p.doc_id for p in packed if p.start == 0) == times


def test_run_and_queries(spark, tmp_path):
    folder(spark, str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    names = list(queries.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
