from collections import Counter

from gaugewright.llm import quality_rules as q

from . import samples


def brute(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    n = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if n[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in q.SYMBOLS), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measurements_match_brute_force(spark):
    texts = [t for _, t in samples.ODD] + ["a b c d a b c x a b", "l\nl\n\nm\nl", "## | <x>\n" * 3, "a a a a a"]
    for t in texts:
        assert q.measure(t)[:6] == brute(t), t and t[:40]


def test_odd_rows(spark):
    rows = q.apply_policy(q.ledger(samples.odd(spark))).collect()
    assert len(rows) == len(samples.ODD)
    assert all(r.base_failed and not r.kept for r in rows)
    assert q.apply_policy(q.ledger(samples.empty(spark))).count() == 0
    assert q.passing(samples.empty(spark)).columns == samples.odd(spark).columns


def test_policies_and_ablation(spark):
    good, shout, symbols, short = samples.prose(1), samples.prose(2).upper(), samples.prose(3).replace(" ", "### "), "too short"
    df = spark.createDataFrame(list(enumerate([good, shout, symbols, short, short, None])), "doc_id long, text string")
    ledger = q.ledger(df).cache()
    kept = {r.doc_id for r in q.apply_policy(ledger).where("kept").collect()}
    assert kept == {0}
    assert {r.doc_id for r in q.apply_policy(ledger, q.BASE).where("kept").collect()} == {0, 1, 2}
    assert {r.doc_id for r in q.passing(df).collect()} == kept
    told = {r.rule: r for r in q.ablation(ledger).collect()}
    for name, bit in q.BIT.items():
        rest = q.DEFAULT.mask & ~bit
        masks = [r.fail_bits for r in ledger.collect()]
        assert told[name].n_failed == sum(m & bit > 0 for m in masks)
        assert told[name].n_only == sum(m & q.DEFAULT.mask == bit for m in masks)
        assert told[name].n_kept_without == sum(m & rest == 0 for m in masks)


def test_the_ledger_s_bits_are_what_is_filtered_and_ablated(spark):
    texts = [samples.prose(1), samples.prose(2).upper(), samples.prose(3).replace(" ", "### "), "too short", None, *(t for _, t in samples.ODD)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = {r.doc_id: r.fail_bits for r in q.ledger(df).collect()}
    within = df.select("doc_id", q.measured_struct(df.text).alias("m")).select("doc_id", q.mask(within="m").alias("bits"))
    assert {r.doc_id: r.bits for r in within.collect()} == bits
    for p in q.POLICIES.values():
        assert {r.doc_id for r in q.passing(df, p).collect()} == {i for i, b in bits.items() if not b & (p.mask | q.BASE.mask)}


def test_ablation_is_a_query(spark):
    from gaugewright.llm.queries import queries

    told = queries()["op1_rule_ablation"](spark, samples.SF).collect()
    kept = queries()["op1_quality_rules"](spark, samples.SF).where("kept").count()
    n = spark.read.parquet(f"{samples.SF}/documents.parquet").count()
    assert {r.rule for r in told} == set(q.DEFAULT.rules)
    assert all(r.n_kept == kept and r.n_kept_without == kept + r.n_only and r.n_rows == n for r in told)
