"""All queries of the engine's own operators, with the SQL that states the same results.

Samples are the UTF-8 bytes of whole texts. Numeric tables stand in for rules
and trails where parity, hashes and policies are concerned: an order is a rule
(key, customer, customer, 1), a customer's order keys are a trail, a part is a
rule whose usage is the number of its line items.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.hashing import as_hex, hash_rule, hash_symbols
from quillon.functions.symbols import to_trail
from quillon.operators import encoding, hierarchy, integrity, interleave, mining, parity, policy, simulate
from quillon.operators.mining import Gate, Rule
from quillon.plans.lineage import cut, global_ranks, shared_folder, spread
from quillon.sources import generators, readers, snapshot
from quillon.streaming import online

GATE = Gate(4, 1.5, 0.001)
#: A fixed dictionary of common English pairs: th, the, "e ", an, and, "the ", "and ", in.
FIXED = [
    Rule(256, 116, 104, 100), Rule(257, 256, 101, 90), Rule(258, 101, 32, 80), Rule(259, 97, 110, 70),
    Rule(260, 259, 100, 60), Rule(261, 257, 32, 50), Rule(262, 260, 32, 40), Rule(263, 105, 110, 30),
]
LAYERS = 3
BLOCK = 8
#: The reference's budgets of training: one dictionary, what consolidation adds to one, retraining in steps, and by capacity.
TRAINED, ADDED, STEPS, RETRAINED = 128, 64, 12, 128
CAPACITIES = (64, 128, 256, 512)
#: Rules of the queries that show the start of a longer training.
FIRST = 16
#: The reference's budgets of online learning: rules a sample, and where samples come in several orders.
ONLINE, ONLINE_ORDERS = 16, 24
#: The reference's budget of each cycle's consolidation.
CONSOLIDATED = 64
#: The reference's numbers of random trials.
TRIALS, SWEEP_TRIALS, INTEGRATED_TRIALS = 5000, 1500, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more).where("text IS NOT NULL"))
    return encoding.text_samples(docs).drop("text")


def _bytes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL"))
    return readers.text_bytes(docs, "doc_id").select("sample_ord", F.hex("content").alias("h"))


def _orders_as_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("long").alias("idx"), F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("left"),
        (F.col("o_custkey") * 65537 + F.col("o_orderkey")).cast("long").alias("right"), F.length("o_orderpriority").cast("long").alias("frequency"),
    )


def _order_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").cast("long").alias("trail_id")).agg(F.sort_array(F.collect_list(F.col("o_orderkey").cast("long"))).alias("symbols"))


def _part_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rules = table(spark, sf_dir, "part").select((F.col("p_partkey") + 256).cast("long").alias("id"), F.col("p_size").cast("long").alias("frequency"))
    usage = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") + 256).cast("long").alias("id")).agg(F.count("*").alias("usage"))
    return rules, usage


def _encoded(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return encoding.encode(_documents(spark, sf_dir, *more), FIXED)


# --- mining -----------------------------------------------------------------


def pair_counts(spark, d):
    return mining.pair_counts(_documents(spark, d))


def pair_scores(spark, d):
    s = mining.score_pairs(pair_counts(spark, d))
    return s.select("left", "right", "n", "left_n", "right_n", *[F.round(c, 9).alias(c) for c in ("support", "expected", "lift", "score")])


def best_pair(spark, d):
    return mining.best_pair(_documents(spark, d), GATE).select("left", "right", "n", F.round("score", 6).alias("score"))


def pair_frequency(spark, d):
    docs = _documents(spark, d)
    th, ll = mining.pair_frequency(docs, 116, 104), mining.pair_frequency(docs, 108, 108)
    return th.select(F.lit("th").alias("pair"), "n").unionByName(ll.select(F.lit("ll").alias("pair"), "n"))


def replace_pair(spark, d):
    return _documents(spark, d).select("doc_id", F.length(mining.replace_pair(F.col("z"), 116, 104, 256)).cast("long").alias("trail_length"))


def train_rules(spark, d):
    return mining.rules_frame(spark, mining.train(_documents(spark, d), TRAINED, GATE))


def train_first(spark, d):
    """The first rules of train_rules, as many as SQL finds in time."""
    return mining.rules_frame(spark, mining.train(_documents(spark, d), FIRST, GATE))


def _consolidated(spark, d, budget):
    trails = _encoded(spark, d).select(F.col("encoded").alias("z"))
    return mining.rules_frame(spark, mining.consolidate(trails, FIXED, budget, GATE)[len(FIXED):])


def consolidate_rules(spark, d):
    return _consolidated(spark, d, ADDED)


def consolidate_first(spark, d):
    """The first rules of consolidate_rules, as many as SQL finds in time."""
    return _consolidated(spark, d, FIRST)


# --- encoding ---------------------------------------------------------------


def encode_fixed_rules(spark, d):
    return _encoded(spark, d).select("doc_id", "input_bytes", "trail_length", "rules_applied", F.md5(F.array_join(to_trail(F.col("encoded")).cast("array<string>"), ",").cast("binary")).alias("trail_md5"))


def encode_cost(spark, d):
    e = _encoded(spark, d, "lang").withColumn("ok", encoding.decode(F.col("encoded"), FIXED) == F.encode("z", "ISO-8859-1"))
    cost = encoding.symbol_cost(F.col("trail_length"), F.col("input_bytes"))
    return e.groupBy("lang").agg(
        F.count("*").alias("samples"), F.round(F.avg(cost), 9).alias("symbols_per_byte"),
        F.sum(encoding.model_cost(F.col("trail_length"), F.lit(len(FIXED)))).alias("model_cost"), F.bool_and("ok").alias("exact"),
    )


def rules_per_kib(spark, d):
    e = _encoded(spark, d, "source").groupBy("source").agg(F.sum("input_bytes").alias("bytes"))
    return e.select("source", "bytes", F.round(encoding.rules_per_kib(F.lit(len(FIXED)), F.col("bytes")), 9).alias("rules_per_kib"))


def decode_roundtrip(spark, d):
    content = encoding.decode(F.col("encoded"), FIXED)
    return _encoded(spark, d).select("doc_id", F.octet_length(content).cast("long").alias("bytes"), F.md5(content).alias("md5"))


def compiled_encode(spark, d):
    c = encoding.compiled_encode(_documents(spark, d), FIXED)
    return c.select("doc_id", F.size("compiled_trail").cast("long").alias("trail_length"), "matched_bytes", "matched_rules")


def trie_node_count(spark, d):
    return encoding.trie_node_count(spark, FIXED)


# --- fixed hierarchy --------------------------------------------------------


def _hierarchy(spark, d):
    samples = _bytes_of(spark, d)
    return samples, hierarchy.nodes(samples, LAYERS)


def hier_relations(spark, d):
    return hierarchy.relations(_hierarchy(spark, d)[1]).select("id", "left", "right", F.col("layer").cast("int").alias("layer"), "ref_count")


def hier_ref_counts(spark, d):
    r = hierarchy.relations(_hierarchy(spark, d)[1])
    return r.groupBy(F.col("layer").cast("int").alias("layer")).agg(F.count("*").alias("relations"), F.sum("ref_count").alias("refs"), F.max("ref_count").alias("most"))


def hier_trail_len(spark, d):
    samples, nodes = _hierarchy(spark, d)
    used = nodes.groupBy("ord").agg(F.count("*").alias("relations_used"))
    out = samples.withColumn("n", (F.length("h") / 2).cast("long")).join(used, samples["sample_ord"] == used["ord"], "left")
    return out.select(F.col("sample_ord").alias("doc_id"), hierarchy.trail_length("n", LAYERS).alias("trail_length"), F.coalesce("relations_used", F.lit(0)).cast("long").alias("relations_used"))


def hier_cost(spark, d):
    samples, nodes = _hierarchy(spark, d)
    new = nodes.groupBy("key").agg(F.min("ord").alias("ord")).groupBy("ord").agg(F.count("*").alias("new_relations"))
    out = samples.withColumn("n", (F.length("h") / 2).cast("long")).join(new, samples["sample_ord"] == new["ord"], "left")
    fresh = F.coalesce("new_relations", F.lit(0)).cast("long")
    return out.select(F.col("sample_ord").alias("doc_id"), fresh.alias("new_relations"), encoding.inference_cost(hierarchy.trail_length("n", LAYERS), fresh).alias("cost"))


def hier_roundtrip(spark, d):
    samples, nodes = _hierarchy(spark, d)
    known = cut(hierarchy.relations(nodes))
    back = hierarchy.decode(hierarchy.encode(samples, known, LAYERS), known)
    joined = samples.join(back.withColumnRenamed("h", "back"), samples["sample_ord"] == back["ord"], "left")
    return joined.select(F.col("sample_ord").alias("doc_id"), F.md5(F.unhex(F.coalesce("back", F.lit("")))).alias("md5"))


# --- integrity --------------------------------------------------------------


def rule_hash(spark, d):
    c = [F.col(x).cast("long") for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    return spread(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).select(*[x.alias(n) for x, n in zip(c, ("id", "left", "right", "frequency"), strict=True)], as_hex(hash_rule(*c)).alias("hash"))


def trail_hash(spark, d):
    return _order_trails(spark, d).select("trail_id", as_hex(hash_symbols(F.col("symbols"))).alias("hash"))


def trail_block_hash(spark, d):
    return integrity.block_hashes(_order_trails(spark, d), BLOCK).select("trail_id", "block", as_hex(F.col("hash")).alias("hash"))


def corrupted_rules(spark, d):
    rules = _orders_as_rules(spark, d)
    damaged = rules.where("id % 101 <> 0").withColumn("right", F.when(F.col("id") % 97 == 0, F.col("right").bitwiseXOR(1)).otherwise(F.col("right")))
    return integrity.corrupted_rules(integrity.rule_hashes(rules), damaged)


def _flip(symbols, every):
    return F.transform(symbols, lambda x: F.when(x % every == 0, x.bitwiseXOR(1)).otherwise(x))


def corrupted_blocks(spark, d):
    trails = _order_trails(spark, d)
    return integrity.corrupted_blocks(integrity.block_hashes(trails, BLOCK), trails.withColumn("symbols", _flip("symbols", 97)), BLOCK)


def verify_trail(spark, d):
    trails = _order_trails(spark, d)
    return integrity.verify_trails(integrity.trail_hashes(trails), trails.withColumn("symbols", _flip("symbols", 97)))


# --- parity and recovery ----------------------------------------------------


def rule_parity(spark, d):
    return parity.rule_parity(_orders_as_rules(spark, d))


def rule_dual_parity(spark, d):
    p = parity.rule_dual_parity(_orders_as_rules(spark, d))
    return p.select("grp", "begin_index", "count", *[as_hex(F.col(c)).alias(c) for f in parity.FIELDS for c in (f"p_{f}", f"q_{f}")])


def trail_parity(spark, d):
    return parity.trail_parity(_order_trails(spark, d), BLOCK)


def trail_dual_parity(spark, d):
    p = parity.trail_dual_parity(_order_trails(spark, d), BLOCK)
    return p.select("trail_id", "block", "begin_index", "count", as_hex(F.col("p")).alias("p"), as_hex(F.col("q")).alias("q"))


def recover_one_rule(spark, d):
    rules = _orders_as_rules(spark, d)
    lost = rules.where("pmod(idx, 8) = pmod(floor(idx / 8), 8)").select("idx")
    damaged = rules.join(lost.withColumn("x", F.lit(True)), "idx", "left")
    damaged = damaged.select("idx", *[F.when(F.col("x"), F.col(f).bitwiseXOR(0x55)).otherwise(F.col(f)).alias(f) for f in parity.FIELDS])
    return parity.recover_one_rule(parity.rule_parity(rules), damaged, lost)


def recover_two_rules(spark, d):
    rules = _orders_as_rules(spark, d)
    made = parity.rule_dual_parity(rules)
    lost = made.where("count >= 2").select("grp", "begin_index", (F.col("begin_index") + F.pmod(F.col("grp"), F.col("count") - 1)).alias("a"), (F.col("begin_index") + F.col("count") - 1).alias("b"))
    return parity.recover_two_rules(made, rules, lost.select("grp", "a", "b"))


def _damaged(trails, places):
    """trails with the first symbol of every block changed, and for two places the last one too."""
    first = lambda i: i % BLOCK == 0
    last = lambda i: (i % BLOCK == BLOCK - 1) | (i == F.size("symbols") - 1)
    hit = (lambda i: first(i) | last(i)) if places == 2 else first
    return trails.withColumn("symbols", F.transform("symbols", lambda x, i: F.when(hit(i), x.bitwiseXOR(0x1234 + i)).otherwise(x)))


def _written_out(repaired):
    return repaired.select("trail_id", "block", F.array_join(F.col("repaired").cast("array<string>"), ",").alias("repaired"))


def recover_one_symbol(spark, d):
    trails = _order_trails(spark, d)
    made = parity.trail_parity(trails, BLOCK)
    return _written_out(parity.recover_one_symbol(integrity.block_hashes(trails, BLOCK), made, _damaged(trails, 1), BLOCK))


def recover_two_symbols(spark, d):
    trails = _order_trails(spark, d)
    made = parity.trail_dual_parity(trails, BLOCK)
    return _written_out(parity.recover_two_symbols(integrity.block_hashes(trails, BLOCK), made, _damaged(trails, 2), BLOCK))


def interleave_order(spark, d):
    return interleave.interleaved_order(spark, table(spark, d, "orders").count(), 64)


def interleave_inverse(spark, d):
    n = table(spark, d, "orders").count()
    order = interleave.interleaved_order(spark, n, 64)
    return interleave.inverse_order(order).join(order.withColumnRenamed("pos", "again"), "idx").select("idx", "pos", (F.col("pos") == F.col("again")).alias("inverse"))


# --- policy -----------------------------------------------------------------


def rule_usage(spark, d):
    trails = _encoded(spark, d).select(to_trail(F.col("encoded")).alias("symbols"))
    return policy.rule_usage(trails, mining.rules_frame(spark, FIXED))


def _decisions(spark, d):
    return policy.rule_protection(*_part_rules(spark, d))


def rule_protection(spark, d):
    return _decisions(spark, d).withColumn("criticality", F.round("criticality", 9)).withColumn("parity", F.col("parity").cast("int"))


def protection_buckets(spark, d):
    b = policy.buckets(_decisions(spark, d).withColumn("idx", F.col("id") - 256))
    return b.select("profile", F.size("positions").alias("n"), F.md5(F.array_join(F.col("positions").cast("array<string>"), ",").cast("binary")).alias("positions_md5"))


def parity_cost(spark, d):
    return policy.parity_cost(_decisions(spark, d)).select("rules", "light", "medium", "strong", "adaptive_parity", "uniform_strong_parity", F.round("saving_vs_strong", 9).alias("saving_vs_strong"), F.round("strong_usage_share", 9).alias("strong_usage_share"))


def trail_protection(spark, d):
    trails = _encoded(spark, d).select(F.col("doc_id").alias("trail_index"), to_trail(F.col("encoded")).alias("symbols"))
    accesses = table(spark, d, "events").groupBy(F.col("user_id").cast("long").alias("trail_index")).agg(F.count("*").alias("access_count"))
    out = policy.trail_protection(trails, accesses, len(FIXED))
    return out.withColumns({c: F.round(c, 9) for c in ("shared_rule_fraction", "criticality")})


# --- simulation -------------------------------------------------------------


def burst_failure(spark, d):
    return simulate.burst_failure(spark).withColumn("probability", F.round("probability", 9))


def max_burst(spark, d):
    return simulate.max_burst(spark)


def overhead_model(spark, d):
    return simulate.overhead(spark).withColumn("overhead_pct", F.round("overhead_pct", 6))


def _zipf(spark):
    rules = generators.zipf_usage(spark)
    d = policy.rule_protection(rules.select("id", "frequency"), rules.select("id", "usage"))
    return cut(d.withColumn("idx", F.col("id") - 256))


def random_failure(spark, d):
    return simulate.random_failure(spark, trials=TRIALS)


def profile_failure(spark, d):
    return simulate.profile_failure(spark, trials=TRIALS)


def criticality_failure(spark, d):
    return simulate.rule_failure(_zipf(spark), 1000, trials=TRIALS)


def group_failure(spark, d):
    return simulate.group_failure(_zipf(spark), 1000, trials=TRIALS)


def group_parity(spark, d):
    return simulate.group_parity(_zipf(spark))


def quantile_sweep(spark, d):
    rules = generators.zipf_usage(spark)
    return simulate.quantile_sweep(rules.select("id", "frequency"), rules.select("id", "usage"), 1000, trials=SWEEP_TRIALS)


def sweep_parity(spark, d):
    rules = generators.zipf_usage(spark)
    out = simulate.quantile_sweep(rules.select("id", "frequency"), rules.select("id", "usage"), 1000, simulate=False)
    return out.select("medium_q", "strong_q", F.round("mean_parity", 9).alias("mean_parity"))


def integrated_failure(spark, d):
    return simulate.integrated(_zipf(spark), trials=INTEGRATED_TRIALS)


# --- sources ----------------------------------------------------------------


def read_window(spark, d):
    """The windowed reader over the bytes of every page."""
    pages = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return readers.window(pages).select("page_id", F.octet_length("w").cast("long").alias("bytes"), F.md5("w").alias("md5"))


def scale_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    out = None
    for size in (2048, 8192, 32768):
        w = readers.window(docs, size).agg(F.count("*").alias("samples"), F.sum(F.octet_length("w")).cast("long").alias("bytes"))
        one = w.select(F.lit(size).cast("long").alias("size"), "samples", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), (F.col("samples") * size).alias("nominal_bytes"))
        out = one if out is None else out.unionByName(one)
    return out


def gen_families(spark, d):
    f = generators.families(spark)
    return f.select("family", F.size("bytes").cast("long").alias("n"), F.md5(generators.to_binary(F.col("bytes"))).alias("md5"))


def gen_corpora(spark, d):
    both = [g(spark).select(F.lit(k).alias("corpus"), "sample_ord", "bytes") for k, g in (("protection", generators.protection_corpus), ("mixed", generators.mixed_corpus))]
    return both[0].unionByName(both[1]).select("corpus", "sample_ord", F.size("bytes").cast("long").alias("n"), F.md5(generators.to_binary(F.col("bytes"))).alias("md5"))


def gen_noise(spark, d):
    motif = [65, 66, 67, 68, 65, 66, 67, 68, 48, 48, 88, 89, 88, 89, 48, 48]
    plain = spark.range(1).select(generators.patterned(motif, 4096, 3, 97).alias("a"), generators.sparse_noise(generators.repeat_pattern(motif, 4096, 5), 61, 7).alias("b"), generators.xorshift_bytes(256, 2463534242).alias("c"))
    mixed = plain.select("a", "b", "c", generators.mix_half(F.col("a"), F.col("b")).alias("m"))
    return mixed.select(F.posexplode(F.array("a", "b", "c", "m")).alias("k", "x")).select("k", F.size("x").cast("long").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.md5(generators.to_binary(F.col("x"))).alias("md5"))


def zipf_usage(spark, d):
    return generators.zipf_usage(spark)


def _shared_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def snapshot_roundtrip(spark, d):
    rules = mining.rules_frame(spark, FIXED)
    trails = _encoded(spark, d).select(F.col("doc_id").alias("trail_id"), to_trail(F.col("encoded")).alias("symbols"))
    path = _shared_folder(spark)
    snapshot.save_tables(rules, trails, path)
    _, back = snapshot.load_tables(spark, path)
    return back.select("trail_id", F.size("symbols").cast("long").alias("n"), F.md5(F.array_join(F.col("symbols").cast("array<string>"), ",").cast("binary")).alias("md5"))


# --- learning loops, over the benchmark table --------------------------------


def _items(spark, d):
    return table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", F.encode("text", "UTF-8").alias("content"))


def online_rules(spark, d):
    rules, _ = online.learn_online(_items(spark, d), "item_id", "content", max_new=ONLINE, gate=GATE)
    return mining.rules_frame(spark, rules)


def stream_rules(spark, d):
    """The same, as a stream of files through foreachBatch."""
    items, folder = _items(spark, d), _shared_folder(spark)
    items.write.parquet(f"{folder}/items")
    learner = online.StreamLearner("item_id", "content", ONLINE, GATE)
    query = learner.start(spark.readStream.schema(items.schema).parquet(f"{folder}/items"), f"{folder}/progress")
    query.awaitTermination()
    return mining.rules_frame(spark, learner.rules)


def retention_check(spark, d):
    """Every trail, encoded by the rules known when its sample arrived, still decodes after all later learning."""
    rules, steps = online.learn_online(_items(spark, d), "item_id", "content", max_new=ONLINE, gate=GATE)
    known = [sum(n for n, _ in steps[:k]) for k in range(len(steps))]
    ranked = global_ranks(_items(spark, d), "item_id")
    at = spark.createDataFrame(list(enumerate(known)), "rank long, known int")  # a row per sample, two numbers
    z = F.decode("content", "ISO-8859-1")
    stored = ranked.join(at, "rank").select(F.col("rank").alias("ord"), mining.apply_rules(z, rules, F.col("known")).alias("encoded"))
    return stored.select("ord", F.md5(encoding.decode(F.col("encoded"), rules)).alias("md5"))


def incremental_growth(spark, d):
    """Retraining on all items seen so far, a twelfth of them at a time."""
    ranked = cut(global_ranks(_items(spark, d), "item_id"))
    total, out, before = ranked.count(), [], 0
    for step in range(1, STEPS + 1):
        seen = total * step // STEPS
        if not seen:
            continue
        n = len(mining.train(ranked.where(F.col("rank") < seen).select(F.decode("content", "ISO-8859-1").alias("z")), RETRAINED, GATE))
        out.append((step, seen, n, max(n - before, 0)))
        before = n
    return spark.createDataFrame(out, "step int, samples long, rules long, growth long")


def capacity_sweep(spark, d):
    """Cost by capacity; a smaller budget's dictionary is the start of a larger one's."""
    samples = _items(spark, d).select(F.decode("content", "ISO-8859-1").alias("z"))
    rules = mining.train(samples, max(CAPACITIES), GATE)
    out = None
    for capacity in CAPACITIES:
        e = encoding.encode(samples, rules[:capacity]).agg(F.round(F.avg(encoding.symbol_cost(F.col("trail_length"), F.col("input_bytes"))), 9).alias("cost"))
        one = e.select(F.lit(capacity).alias("capacity"), F.lit(min(capacity, len(rules))).alias("rules"), "cost")
        out = one if out is None else out.unionByName(one)
    return out


def _mean_cost(samples, rules):
    """Mean symbols a byte of samples (content) as the rules encode them."""
    e = encoding.encode(samples.select(F.decode("content", "ISO-8859-1").alias("z")), rules)
    return e.agg(F.round(F.coalesce(F.avg(encoding.symbol_cost(F.nullif("trail_length", F.lit(0).cast("long")), F.col("input_bytes"))), F.lit(0.0)), 9)).first()[0]


def order_retention(spark, d):
    """Rules and mean cost for items in order, in reverse and in six seeded shuffles."""
    items, out = cut(global_ranks(_items(spark, d), "item_id")), []
    for run in range(8):
        at = F.col("rank") if run == 0 else -F.col("rank") if run == 1 else F.xxhash64("rank", F.lit(run))
        rules, _ = online.learn_online(items.withColumn("at", at), "at", "content", max_new=ONLINE_ORDERS, gate=GATE)
        out.append((run, len(rules), _mean_cost(items, rules)))
    return spark.createDataFrame(out, "run int, rules long, mean_cost double")


def multicycle(spark, d):
    """Four cycles: a quarter of the items online, then consolidation over all seen, encoded anew."""
    items = cut(global_ranks(_items(spark, d), "item_id"))
    total, rules, out = items.count(), [], []
    for cycle in range(4):
        low, high = total * cycle // 4, total * (cycle + 1) // 4
        rules, _ = online.learn_online(items.where(F.col("rank").between(low, high - 1)), "rank", "content", rules, ONLINE, GATE)
        seen, before = items.where(F.col("rank") < high), len(rules)
        trails = encoding.encode(seen.select(F.decode("content", "ISO-8859-1").alias("z")), rules).select(F.col("encoded").alias("z"))
        rules = mining.consolidate(trails, rules, CONSOLIDATED, GATE)
        out.append((cycle + 1, before, len(rules) - before, len(rules), _mean_cost(seen, rules)))
    return spark.createDataFrame(out, "cycle int, before long, added long, after long, mean_cost double")


def mined_recovery(spark, d):
    """Mine a dictionary, protect it, lose every eighth rule, find the loss by its hashes and restore it from parity."""
    rules = mining.rules_frame(spark, mining.train(_documents(spark, d), FIRST, GATE)).withColumn("idx", F.col("id") - 256)
    damaged = rules.withColumn("right", F.when(F.pmod("idx", F.lit(8)) == 3, F.col("right").bitwiseXOR(0x55)).otherwise(F.col("right")))
    lost = integrity.corrupted_rules(integrity.rule_hashes(rules), damaged)
    return parity.recover_one_rule(parity.rule_parity(rules), damaged, lost)


_QUERIES = (
    pair_counts, pair_scores, best_pair, pair_frequency, replace_pair, train_rules, train_first, consolidate_rules, consolidate_first,
    encode_fixed_rules, encode_cost, rules_per_kib, decode_roundtrip, compiled_encode, trie_node_count,
    hier_relations, hier_ref_counts, hier_trail_len, hier_cost, hier_roundtrip,
    rule_hash, trail_hash, trail_block_hash, corrupted_rules, corrupted_blocks, verify_trail,
    rule_parity, rule_dual_parity, trail_parity, trail_dual_parity,
    recover_one_rule, recover_two_rules, recover_one_symbol, recover_two_symbols, interleave_order, interleave_inverse,
    rule_usage, rule_protection, protection_buckets, parity_cost, trail_protection,
    burst_failure, max_burst, overhead_model, random_failure, profile_failure, criticality_failure, group_failure, group_parity,
    quantile_sweep, sweep_parity, integrated_failure,
    read_window, scale_windows, gen_families, gen_corpora, gen_noise, zipf_usage, snapshot_roundtrip,
    online_rules, stream_rules, retention_check, incremental_growth, capacity_sweep, order_retention, multicycle, mined_recovery,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on all documents, encode them, and give cost and exact reconstruction by language."""
    docs = _documents(spark, sf_dir, "lang")
    rules = mining.train(docs, 8, GATE)
    e = encoding.encode(docs, rules).withColumn("ok", encoding.decode(F.col("encoded"), rules) == F.encode("z", "ISO-8859-1"))
    cost = encoding.symbol_cost(F.col("trail_length"), F.col("input_bytes"))
    return e.groupBy("lang").agg(F.count("*").alias("samples"), F.avg(cost).alias("symbols_per_byte"), F.bool_and("ok").alias("exact"))


def oracle_sql() -> dict[str, str]:
    from quillon.oracle import ORACLE

    return dict(ORACLE)


