import random

from claimweave.operators import search as S


def brute(companies, queries, limit):
    out = set()
    for query in set(queries):
        q, found = query.strip(" ").lower(), []
        for pos, ticker, name, _ in companies:
            t, n = ticker.lower(), (name or "").lower()
            score = None if not q else 0 if t == q else 1 if t.startswith(q) else 2 if q in n else 3 if q in t else None
            if score is not None:
                found.append((score, len(ticker), pos, ticker))
        out |= {(query, i + 1, f[3], f[0]) for i, f in enumerate(sorted(found)[:limit])}
    return out


def test_equal_to_brute_force_without_a_cross_join(spark):
    rnd = random.Random(9)
    syllables = ["ac", "me", "corp", "inc", " ", "é", "Ä", "x", "O'", "%", "_", "inc."]
    companies = [(i, "".join(rnd.choice("ABCDEX.") for _ in range(rnd.randint(1, 5))), "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 6))), i) for i in range(1500)]
    companies += [(1500, "NUL", None, 1)]
    queries = ["", "  ", "a", " A ", "ab", "inc", "corp inc", "é", "ä", "o'", "%", "_", "zzz", "nul", "acmecorp", "INC.", "b", "b"] + [c[2][:4] for c in companies[:60]] + [c[1] for c in companies[:40]]
    universe = spark.createDataFrame(companies, "pos int, ticker string, name string, cik long")
    asked, processed = spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(companies[0][1],)], "ticker string")
    for grams in (None, S.company_grams(universe)):
        got = S.company_search(universe, asked, processed, 15, grams)
        plan = got._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        rows = got.collect()
        assert {(r.query, r["rank"], r.ticker, r.score) for r in rows} == brute(companies, queries, 15)
        assert {r.processed for r in rows if r.ticker == companies[0][1]} <= {True} and any(not r.processed for r in rows)
