"""Small documents with the cases that every operator must bear."""

import random

WORDS = [a + b + c for a in ("ba", "ko", "li", "mu", "ne") for b in ("ra", "to", "vi", "su", "de") for c in ("", "n", "s", "th", "nd", "ly")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    out = []
    for k in range(n):
        w = rng.choice(WORDS)
        out.append(w.capitalize() if k % 12 == 0 else w + ("." if k % 12 == 11 else ""))
    return " ".join(out)


def rows(seed=1, n=40):
    """Random prose, exact and near copies, a shared passage, odd texts, repeated rows and nulls."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(20, 220)) for _ in range(n)]
    passage = prose(rng, 60)
    texts += [texts[0], texts[1], texts[1]]
    near = texts[2].split()
    near[len(near) // 2] = "changed"
    texts.append(" ".join(near))
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(3)]
    texts += ["", " \n\t ", "one", "two words", "x " * 200, "ab " * 50 + "cd", "ünï çödé 日本語 " * 20, None, None, texts[3] + " " + texts[3]]
    texts.append(prose(rng, 6000))
    out = [(k, t, "en", [None, "a", "b", "c"][k % 4], len(t or "")) for k, t in enumerate(texts)]
    out += [(out[5]), (None, "a text without an id " * 9, None, None, None), (None, None, None, None, None)]
    return out


def documents(spark, **options):
    return spark.createDataFrame(rows(**options), SCHEMA)


def clashing(spark):
    """The same rows with columns named as operators name theirs."""
    from pyspark.sql import functions as F

    names = ("k1", "k2", "rid", "row", "score", "_score", "covered", "n_words", "kept", "_size", "_row", "_s", "_shard", "again", "norm", "hits", "marks", "next_text", "_host", "size", "label")
    return documents(spark).withColumns({n: F.lit(k) for k, n in enumerate(names)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
