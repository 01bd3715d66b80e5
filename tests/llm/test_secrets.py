"""Operator 3 against its SQL and a scan by Python's own patterns."""

import hashlib
import re

from compare import compare, connect

from fluxbook.llm.secrets import BASE_RULES, LEDGER, MASK, OP3_SQL, RULES, Rule, op3_secret_scan, redact_secrets, scan_secrets

PATTERNS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 16), ("hex", r"[0-9a-f]+", 0, 0, 32),
]


def brute(text):
    out = []
    for rank, (kind, pattern, flags, group, least) in enumerate(PATTERNS):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "", flags) if len(m.group(group)) >= least]
    return sorted(out)


def test_equals_sql(spark, folder, document_table):
    path = folder(documents=document_table)
    assert compare(op3_secret_scan(spark, path), connect(path), OP3_SQL) is None


def test_base_spans(documents, corpus):
    found = sorted([(r["doc_id"], [tuple(s) for s in r["found"]]) for r in scan_secrets(documents, rules=BASE_RULES).collect()], key=str)
    assert found == sorted([(r[0], brute(r[1])) for r in corpus], key=str)
    assert sum(len(spans) for _, spans in found) >= 7


def test_digest(spark, folder, document_table, corpus):
    digests = {r["doc_id"]: r["base_sha256"] for r in op3_secret_scan(spark, folder(documents=document_table)).collect()}
    for own, text, *_ in corpus:
        if own is not None:
            listed = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in brute(text))
            assert digests[own] == hashlib.sha256(listed.encode()).hexdigest()


def test_ledger_scans_only_what_is_new(spark, frame, folder):
    ledger = folder() + "/ledger"
    one = frame([(1, "password=longenough1"), (2, "password=longenough1"), (3, None)], "doc_id long, text string")
    scan_secrets(one, ledger=ledger).collect()
    read = lambda: spark.read.schema(LEDGER).parquet(ledger).count()
    assert read() == 2 * len(RULES)  # one blob of both copies, one empty blob
    scan_secrets(one, ledger=ledger).collect()
    assert read() == 2 * len(RULES)
    two = one.union(frame([(4, "nothing here"), (5, "password=longenough1")], "doc_id long, text string"))
    found = {r["doc_id"]: len(r["found"]) for r in scan_secrets(two, ledger=ledger).collect()}
    assert read() == 3 * len(RULES) and found == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    newer = [*RULES[:-1], Rule("pem", 2, "nothing", 0, 1)]
    found = {r["doc_id"]: len(r["found"]) for r in scan_secrets(two, rules=newer, ledger=ledger).collect()}
    assert read() == 3 * len(RULES) + 3 and found[4] == 1


def test_redaction(documents, corpus):
    masked = redact_secrets(documents, rules=BASE_RULES)
    assert masked.columns == documents.columns

    def expected(text):
        out, end = [], 0
        for start, _, stop, _ in brute(text):
            if start > end or not out:
                out.append(text[end:start] + MASK)
            end = max(end, stop)
        return text if not out else "".join(out) + text[end:]

    assert sorted([(r["doc_id"], r["text"]) for r in masked.collect()], key=str) == sorted([(r[0], expected(r[1])) for r in corpus], key=str)


def test_empty(no_documents):
    assert scan_secrets(no_documents).collect() == []
    assert redact_secrets(no_documents).collect() == []
