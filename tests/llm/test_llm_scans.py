"""Secrets (1) and personal data (3) against plain Python patterns."""

import hashlib
import random
import re

from test_llm_fixtures import empty_docs, odd_docs, prose

from postlens.llm import pii, secrets


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def luhn(x):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(x))) % 10 == 0


def base_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def compare(got, texts, base, names):
    for i, t in texts.items():
        said = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))
        assert [got[i][f"n_{n}"] for n in names] == [sum(k == x for _, k, _ in base(t or "")) for x in range(len(names))]


def test_secrets_base(spark):
    rng = random.Random(5)
    parts = ["password", "Passwd", "ſecret", "token", "api_key", "APIKEY", "'", '"', " ", "=", ":", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "é", "_", "\n"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for i in range(1500)}
    texts |= {9001: None, 9002: "token" + " " * 30_000 + "=abcdefghij", 9003: "0a" * 40_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    compare({r.doc_id: r for r in secrets.scan_digest(docs).collect()}, texts, base_secrets, ("assign", "access", "hex"))


def test_novel_strings_are_reported_and_plain_ones_not(spark):
    key = "q7Zt9LmXw2RbVk8sYc4NfHp6JdGu3TeA"
    code = "\n".join(f"session_handler_{i} = load_session_handler_{i}(request_context)" for i in range(40))
    texts = [
        (1, f"{code}\nthe credential for staging is {key} and it works\n{code}"),
        (2, f"{code}\nthe credential for staging is load_session_handler_12 and it works\n{code}"),
        (3, f"no such word here {key}"),
    ]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [s.value for s in got[1].spans] == [key] and got[1].spans[0].kind == "novel"
    assert not got[2].spans and not got[3].spans


def test_passwords_in_addresses_and_runs_without_digits(spark):
    a, b = "q7Zt9LmXw2RbVk8sYc4NfHp6", "qZtLmXwRbVksYcNfHpJdGuTeAqWxEvRyBzKo"
    texts = [
        (1, f"conn_str postgres://svc:{a}@db.host/x"),
        (2, f"credential {b} end"),
        (3, "credential process_billing_account_number end, credential thisisaplainlowercaseword"),
        (4, f"credential someone.with.a.long.{a}@mail.example"),
    ]
    got = {r.doc_id: [s.value for s in r.spans] for r in secrets.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: [a], 2: [b], 3: [], 4: []}


def test_every_value_run_in_reach_is_measured(spark):
    a, b, c = "q7Zt9LmXw2RbVk8sYc4NfHp6JdGu3TeA", "Xc5vBn8mKl2jHg4fDs9aPo7iUy3tRe6w", "Wq8nTz3kLr6yHd5xMf9bSg2vJc7pEa4u"
    texts = [
        (1, f"the credential of billing-service-account is {a}"),
        (2, f"credential pair {a} {b}"),
        (3, f"credential pair\n{a} and {'so on ' * 9}{b}\nbearer {c}"),
        (4, f"secretoken{'.' * 3} {'x ' * 20}{a}, credential {'x ' * 22}{b} and {c}"),
        (5, f"credential {'x ' * 24}{a}"),
    ]
    got = {r.doc_id: [s.value for s in r.spans] for r in secrets.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: [a], 2: [a, b], 3: [c], 4: [a, b], 5: []}
    scanner, rng = secrets.Scanner(b""), random.Random(6)
    parts = ["secretoken", "conn_str", "api-key", "q7Zt9LmXw2RbVk8sYc4", "billing-service-account", " ", " is ", "\n", "@", "x" * 15, "é"]
    solid = "A-Za-z0-9+/_.=~@-"
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        runs = [m.span() for m in re.finditer(rf"(?<![{solid}])[{solid.replace('@', '')}]{{16,}}(?![{solid}])", t)]
        near = [(i, j) for i, j in runs if any(re.fullmatch(rf"(?ai:{secrets.SENSITIVE})[^\n]{{0,48}}", t[k:i]) for k in range(max(0, i - 80), i))]
        assert list(scanner.candidates(t)) == near, t


def test_identifier_dictionary_counts_the_corpus(spark):
    docs = spark.createDataFrame([(i, "call loadUserName with max_retry_count, see loadUserName") for i in range(50)], "doc_id long, text string")
    words = secrets.identifier_dictionary(docs).split(b"\n")
    assert words[-1] == b"loadUserName" and b"max_retry_count" in words
    assert secrets.identifier_dictionary(empty_docs(spark)) == b""


def test_pii_base(spark):
    rng = random.Random(3)
    letters = list("a1b.@-_%+ ()\n0245é5 ")
    texts = dict(enumerate("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2500)))
    odd = [None, "", "a@b.com_x@y.co.z, 1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 +1 (663) 555-6869 4465758382889437 4465 7583 8288 9437", "a@b.com" * 3000, "1" * 50_000, "a.b" * 20_000 + "@" + "c." * 20_000, "+1" * 20_000]
    texts |= {90_000 + i: t for i, t in enumerate(odd)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    compare({r.doc_id: r for r in pii.pii_digest(docs).collect()}, texts, base_pii, ("email", "ip", "card", "phone"))


def test_terms_that_disclose_an_entity(spark):
    texts = [(i, f"{prose(8, i)} write to zorblax keeper at zed@example.com {prose(8, 100 + i)}") for i in range(6)]
    texts += [(100 + i, f"{prose(40, 200 + i)} at some time") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.all_spans(docs).collect()}
    values = {s.value for s in got[0].spans if s.kind == 4}
    assert {"zorblax", "keeper"} <= values and not values & {"house", "river", "stone"}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "zed@example.com" not in clean[0] and "[EMAIL]" in clean[0] and "zorblax" not in clean[0] and "[WORD]" in clean[0]
    assert clean[100] == texts[6][1]


def test_context_is_the_text_on_either_side(spark):
    rng = random.Random(8)
    parts = ["a@b.org", "zed.long-name@example.com", "+1 (663) 555-6869", "4465758382889437", "10.0.0.1", "999.1.1.1", "12", "33", "é日", "word", "\n", " ", " ", ", ", "x" * 78, "7" * 90, "y" * 90 + "@z.com"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for i in range(600)}
    found = pii.matches(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).where("kind is not null").collect()
    assert len(found) > 1000
    for r in found:
        t = texts[r.doc_id]
        assert (r.before, r.value, r.after) == (t[max(0, r.start - 80):r.start], t[r.start:r.end], t[r.end:r.end + 80])


def test_terms_behind_other_matches_and_line_feeds(spark):
    texts = [(i, f"{prose(8, i)}\nquibble\n4465758382889437 at vextor 12 and 33 zorblax unit 12 on floor 33 card 4465 7583 8288 9437 or 12, 33 mumbro\nfrobnitz") for i in range(4)]
    texts += [(100 + i, f"{prose(40, 200 + i)} at some time") for i in range(200)]
    found = pii.all_spans(spark.createDataFrame(texts, "doc_id long, text string")).where("doc_id = 0").collect()[0].spans
    terms = {s.value for s in found if s.kind == 4}
    assert {"zorblax", "vextor", "mumbro"} <= terms and not terms & {"quibble", "frobnitz"}
    assert all(texts[0][1][s.start:s.end].lower() == s.value for s in found if s.kind == 4)


def test_pii_plan_is_native(spark):
    plan = pii.pii_digest(odd_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    assert secrets.scan_digest(docs).count() == pii.pii_digest(docs).count() == docs.count()
    assert secrets.scan_digest(empty_docs(spark)).count() == pii.pii_digest(empty_docs(spark)).count() == 0
