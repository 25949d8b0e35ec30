"""Secret scans against plain regular expressions and hand-made texts."""

from __future__ import annotations

import hashlib
import re

from corvane.llm import registry, secrets

KINDS = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            if (kind == "assign" and len(m[1]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_op1_base_spans(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op1_secrets(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        expect = brute(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(f"{k}:") for x in expect) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(expect).encode()).hexdigest()
        assert set(expect) <= set(filter(None, r.spans.split(",")))


def test_weak_parts_are_linked_only_together():
    key = "Zk3pQ9xLm2Tr8WvB4nYc"
    whole = f"client_id = svc-main key {key} at https://api.example.com/v1"
    kinds = lambda t: {s.split(":")[0] for s in secrets.scan_text(t)["spans"].split(",") if s}
    assert kinds(whole) == {"identifier", "secret", "endpoint"}
    assert kinds(f"key {key} at https://api.example.com/v1") == set()
    assert kinds("client_id = svc-main at https://api.example.com/v1") == set()
    assert kinds(f"client_id = svc-main\n\nkey {key}\n\nhttps://api.example.com/v1") == set()
    assert kinds(f"client_id = svc-main {'x ' * 400} key {key}") == set()
    assert kinds(f"client_id = svc-main key {key}") == {"secret"}


def test_redaction_and_odd_rows(spark):
    rows = [(1, None, 1), (1, None, 1), (2, "", 2), (None, "é password: hunter22 end", 3), (4, "secret=abcdefg " * 20000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets int")
    out = secrets.redact(df).collect()
    assert [r.text for r in out][:4] == [None, None, "", "é [SECRET] end"] and "abcdefg" not in out[4].text
    got = secrets.scan_documents(df).collect()
    assert [r.secrets.n_assign for r in got] == [0, 0, 0, 1, 20000] and got[3].secrets.base_spans == "assign:2:20"
    assert secrets.scan_documents(df.limit(0)).count() == 0
    assert secrets.redacted_text("token=aaaaaa0123456789abcdef0123456789", "*") == "*"
