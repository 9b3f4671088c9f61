"""Encoding and decoding samples with a dictionary, and what trails cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.symbols import chars, from_text, symbol_of
from quillon.operators.mining import Rule, apply_rules


def expansions(rules: list[Rule]) -> list[str]:
    """The bytes of each rule, as latin-1 strings; a rule refers only to smaller ids."""
    out: list[str] = []
    get = lambda s: chr(s) if s < 256 else out[s - 256]
    for r in rules:
        out.append(get(r.left) + get(r.right))
    return out


def encode(samples: DataFrame, rules: list[Rule], z: str = "z") -> DataFrame:
    """samples with encoded (symbol string), input_bytes, trail_length, rules_applied. No shuffle."""
    out = samples.withColumn("encoded", apply_rules(F.col(z), rules))
    # A replacement makes a trail shorter by one.
    return out.withColumns({
        "input_bytes": F.length(z).cast("long"),
        "trail_length": F.length("encoded").cast("long"),
        "rules_applied": (F.length(z) - F.length("encoded")).cast("long"),
    })


def decode(encoded: Column, rules: list[Rule]) -> Column:
    """The bytes that a symbol string stands for; a symbol that no rule has fails."""
    table = [*(chr(k) for k in range(256)), *expansions(rules)]
    lookup = F.array(*[F.lit(x) for x in table])
    return F.encode(F.array_join(F.transform(chars(encoded), lambda c: F.element_at(lookup, symbol_of(c).cast("int") + 1)), ""), "ISO-8859-1")


def _escape(x: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in x)


def trie_pattern(words: list[str]) -> str:
    """A pattern that matches the longest of the words at a place: the words' prefix tree, branches before ends."""

    def of(group: list[str]) -> str:
        prefix = group[0]
        for w in group[1:]:
            k = 0
            while k < min(len(prefix), len(w)) and prefix[k] == w[k]:
                k += 1
            prefix = prefix[:k]
        rest = sorted({w[len(prefix):] for w in group})
        ends = rest[0] == ""
        rest = [w for w in rest if w]
        if not rest:
            return _escape(prefix)
        heads = sorted({w[0] for w in rest})
        inner = "|".join(of([w for w in rest if w[0] == h]) for h in heads)
        return _escape(prefix) + f"(?:{inner}){'?' if ends else ''}"

    heads = sorted({w[0] for w in words})
    return "|".join(of([w for w in words if w[0] == h]) for h in heads)


def compiled_encode(samples: DataFrame, rules: list[Rule], z: str = "z") -> DataFrame:
    """Longest match over the rules' bytes, else a literal byte: compiled_trail, matched_bytes, matched_rules.

    The rules' prefix tree is compiled into one regular expression. Of rules
    with the same bytes the later one is named.
    """
    words = {w: 256 + k for k, w in enumerate(expansions(rules)) if len(w) > 1}
    pattern = f"(?s){trie_pattern(list(words))}|." if words else "(?s)."
    tokens = F.regexp_extract_all(F.col(z), F.lit(pattern), F.lit(0))
    out = samples.withColumn("_tokens", tokens)
    names = F.map_from_arrays(F.array(*[F.lit(w) for w in words]), F.array(*[F.lit(i).cast("long") for i in words.values()])) if words else F.create_map().cast("map<string,bigint>")
    long = F.filter("_tokens", lambda t: F.length(t) > 1)
    name = lambda t: F.when(F.length(t) == 1, F.ascii(t).cast("long")).otherwise(F.element_at(names, t))
    out = out.withColumns({
        "compiled_trail": F.transform("_tokens", name),
        "matched_bytes": F.aggregate(long, F.lit(0).cast("long"), lambda s, t: s + F.length(t)),
        "matched_rules": F.size(long).cast("long"),
    })
    return out.drop("_tokens")


def trie_node_count(spark, rules: list[Rule]) -> DataFrame:
    """(nodes): the root and the distinct prefixes of the rules' bytes."""
    words = spark.createDataFrame([(w,) for w in expansions(rules) if len(w) > 1], "w string")
    prefixes = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.substring(F.col("w"), F.lit(1), k))).alias("p"))
    return prefixes.agg((F.count_distinct("p") + 1).alias("nodes"))


def text_samples(df: DataFrame, text: str = "text") -> DataFrame:
    """df with z, the symbols of a text column's bytes; a null text stays null."""
    return df.withColumn("z", from_text(F.col(text)))


def symbol_cost(length: Column, input_bytes: Column) -> Column:
    """Symbols per byte; null for an empty sample."""
    return length.cast("double") / F.nullif(input_bytes, F.lit(0).cast("long"))


def inference_cost(trail_length: Column, new_relations: Column | int = 0) -> Column:
    return trail_length + 2 * (new_relations if isinstance(new_relations, Column) else F.lit(new_relations))


def model_cost(trail_length: Column, rules: Column) -> Column:
    return trail_length + 2 * rules


def rules_per_kib(rules: Column, input_bytes: Column) -> Column:
    return rules.cast("double") / (input_bytes.cast("double") / 1024)
