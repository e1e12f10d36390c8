import itertools
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from postlens.operators import nlp as N

SKILLS = ["python,sql,machine learning", "python,sql", "python,sql", "react,node", "java,spring boot,newtool",
          "deep learning,machine learning,pytorch", "newtool,python", None, ""]


def _docs(spark):
    return N.skill_documents(spark.createDataFrame([(s,) for s in SKILLS], "skills string"))


def test_cooccurrence_pruned_equals_brute_force(spark):
    docs = [" ".join(x.strip().lower() for x in s.split(",") if x.strip()) for s in SKILLS if s]
    docs = [d for d in docs if d]
    pairs = Counter()
    for d in docs:
        toks = d.split()
        for i, j in itertools.combinations(range(len(toks)), 2):
            pairs[tuple(sorted((toks[i], toks[j])))] += 1
    want = sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0]))[:15]
    for seeds in (2, 64):  # a tiny seed set forces the pruning path
        got = [((r["a"], r["b"]), r["count"]) for r in N.cooccurrence(_docs(spark), 15, "token", seeds).orderBy("rank").collect()]
        assert got == want, seeds


def test_cooccurrence_of_a_long_document_in_blocks(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(900)), "w1 w2 w2", "w1 w2"]
    pairs = Counter()
    for text, mult in zip(texts, (1, 2, 5), strict=True):
        toks = text.split()
        for i, j in itertools.combinations(range(len(toks)), 2):
            pairs[tuple(sorted((toks[i], toks[j])))] += mult
    want = sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0]))[:40]
    docs = spark.createDataFrame([(t, t.split(), m) for t, m in zip(texts, (1, 2, 5), strict=True)], "doc string, skills array<string>, mult bigint")
    for block in (7, 64, 1000):
        out = N.cooccurrence(docs, 40, "token", 16, block)
        assert [((r["a"], r["b"]), r["count"]) for r in out.orderBy("rank").collect()] == want, block
    plan = N.cooccurrence(docs, 40, "token", 16, 64)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc#\w+, lo#\w+, hi#", plan)  # pairs of blocks are dealt out


def _tfidf_reference(docs):
    toks = [re.findall(r"[a-zA-Z0-9#+.\-]+", d.lower()) for d in docs]
    n = len(docs)
    df = Counter(t for ts in toks for t in set(ts))
    total = Counter(t for ts in toks for t in ts)
    keep = sorted([t for t in df if df[t] >= 2 and df[t] <= 0.95 * n], key=lambda t: (-total[t], t))[:200]
    keep = sorted(keep)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in keep}
    rows = []
    for ts in toks:
        c = Counter(ts)
        v = {t: c[t] * idf[t] for t in keep if c[t]}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        rows.append({t: x / norm for t, x in v.items()})
    return keep, rows, n


def test_tfidf_mean_matches_reference(spark):
    docs = [" ".join(x.strip().lower() for x in s.split(",") if x.strip()) for s in SKILLS if s]
    docs = [d for d in docs if d]
    keep, rows, n = _tfidf_reference(docs)
    want = {t: round(sum(r.get(t, 0.0) for r in rows) / n, 4) for t in keep}
    weights, vocab, nd = N.tfidf(_docs(spark))
    assert sorted(r["term"] for r in vocab.collect()) == keep
    got = {r["term"]: r["score"] for r in N.mean_tfidf(weights, nd, top=200).collect()}
    for t in keep:
        assert abs(got[t] - want[t]) < 1e-9, t


def test_similarity_and_clusters(spark):
    docs = [" ".join(x.strip().lower() for x in s.split(",") if x.strip()) for s in SKILLS if s]
    docs = [d for d in docs if d]
    keep, rows, _ = _tfidf_reference(docs)
    weights, vocab, _ = N.tfidf(_docs(spark))
    sims = {(r["i"], r["j"]): r["sim"] for r in N.term_similarity(weights).collect()}
    for i, j in itertools.combinations(range(len(keep)), 2):
        a, b = keep[i], keep[j]
        dot = sum(r.get(a, 0) * r.get(b, 0) for r in rows)
        na = math.sqrt(sum(r.get(a, 0) ** 2 for r in rows))
        nb = math.sqrt(sum(r.get(b, 0) ** 2 for r in rows))
        want = dot / (na * nb)
        assert abs(sims.get((i, j), 0.0) - want) < 1e-9
    clusters = N.skill_clusters(N.term_similarity(weights), vocab).collect()
    leaders = {r["leader"] for r in clusters}
    members = [r["member"] for r in clusters]
    assert len(members) == len(set(members)) and leaders <= set(keep)


def test_emerging(spark):
    docs = _docs(spark)
    weights, _, n = N.tfidf(docs)
    got = [r["skill"] for r in N.emerging_skills(docs, N.mean_tfidf(weights, n)).collect()]
    assert "newtool" in got and "python" not in got
    assert [r["skill"] for r in N.emerging_skills(docs, None).collect()] == got


def _fold(edges):
    later, used, out = {}, set(), set()
    for i, j in edges:
        later.setdefault(i, set()).add(j)
    for i in sorted(later):
        if i not in used:
            members = [i, *sorted(later[i] - used)]
            used |= set(members)
            out |= {(i, m, k) for k, m in enumerate(members)} if len(members) > 1 else set()
    return out


def test_leader_clusters_equal_the_fold(spark):
    rng = random.Random(6)
    for n, m in ((12, 14), (60, 150), (20_000, 30_000)):
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        df = spark.createDataFrame([*edges, next(iter(edges))], "i int, j int")
        assert {(r.leader, r.member, r.member_order) for r in N.leader_clusters(df).collect()} == _fold(edges)
    assert N.leader_clusters(df.limit(0)).count() == 0


def test_tfidf_of_whole_texts_shuffles_no_tokens_of_a_document(spark):
    from collections import Counter
    import math

    texts = ["spark sql sql", "spark python", "spark sql sql", "python c++ sql", "Java spark", "", "java", None, "python java go"]
    docs = spark.createDataFrame([(t, 1) for t in texts], "doc string, mult long")
    weights, vocab, n = N.tfidf(docs, fold=False)
    got = {(r["term"], round(r["score"], 4)) for r in N.mean_tfidf(weights, n).collect()}
    folded = {(r["term"], round(r["score"], 4)) for r in N.mean_tfidf(N.tfidf(docs)[0], n).collect()}
    counts = [Counter(t.lower().split()) for t in texts if t]
    total, df = len(texts), Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + total) / (1 + d)) + 1 for w, d in df.items() if 2 <= d <= 0.95 * total}
    sums = Counter()
    for c in counts:
        raw = {w: k * idf[w] for w, k in c.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        for w, x in raw.items():
            sums[w] += x / norm
    assert got == folded == {(w, round(s / total, 4)) for w, s in sums.items()}
    assert {r["term"]: r["df"] for r in vocab.collect()} == {w: df[w] for w in idf}
    # one row per different text when folded, with the number of rows that hold it
    twice = N.tfidf(docs)[0].where("term = 'sql' and mult = 2")
    assert twice.count() == 1 and twice.first()["w"] > 0
    plan = weights.groupBy("term").agg(F.sum("w"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert N.tfidf(docs.limit(0))[0].count() == 0
