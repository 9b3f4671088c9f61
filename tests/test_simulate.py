from quillon.operators import simulate


def test_bursts(spark):
    assert {r.layout: r.max_burst for r in simulate.max_burst(spark).collect()} == {"contiguous": 2, "interleaved": 128}
    got = {(r.errors, r.layout): round(r.probability, 4) for r in simulate.burst_failure(spark).collect()}
    assert got[4, "contiguous"] == 0.9846 and got[41, "contiguous"] == 1.0 and got[41, "interleaved"] == 0.0 and got[1, "contiguous"] == 0.0


def test_random_damage_is_near_what_is_published(spark):
    got = {(r.errors, r.layout): r.probability for r in simulate.random_failure(spark, errors=(41,), trials=400).collect()}
    assert abs(got[41, "contiguous"] - 0.85) < 0.08 and abs(got[41, "interleaved"] - 0.85) < 0.08
    by = {r.capacity: (r.overhead, r.probability) for r in simulate.profile_failure(spark, trials=400).collect()}
    assert abs(by[2][1] - 0.856) < 0.08 and abs(by[3][1] - 0.194) < 0.08 and by[6][1] < 0.02 and by[2][0] == 2 / 64


def test_overheads(spark):
    got = {r.metric: r.overhead_pct for r in simulate.overhead(spark).collect()}
    assert got["rule_parity"] == 31.25 and got["rule_total"] == 56.25 and round(got["trail_total"], 2) == 7.81 and round(got["combined"], 2) == 8.00


def test_registered_trials_and_grid(spark, monkeypatch):
    from quillon import catalog

    by = {r.capacity: r.probability for r in catalog.profile_failure(spark, "").collect()}
    assert all(abs(p * 5000 - round(p * 5000)) < 1e-6 for p in by.values()) and any(abs(p * 300 - round(p * 300)) > 1e-6 for p in by.values())
    seen = {}
    for name in ("random_failure", "rule_failure", "group_failure", "quantile_sweep", "integrated"):
        monkeypatch.setattr(simulate, name, lambda *a, _name=name, **k: seen.update({_name: k}))
    for query in ("random_failure", "criticality_failure", "group_failure", "quantile_sweep", "integrated_failure"):
        catalog.queries()[query](spark, "")
    assert seen == {"random_failure": {"trials": 5000}, "rule_failure": {"trials": 5000}, "group_failure": {"trials": 5000}, "quantile_sweep": {"trials": 1500}, "integrated": {"trials": 1000}}
