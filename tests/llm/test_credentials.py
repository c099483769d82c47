"""Credential linking against a brute-force version and DuckDB."""

import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest

from tesserae.llm import credentials, queries

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, row string"

ODD = [
    (1, None),
    (2, ""),
    (3, "password: hunter22 and Passwd='abcdefgh' token=short1"),
    (4, "secret=token: abcdefghij"),
    (5, "AKIA" + "Q" * 12 + " AKIAQQQ AKIA" + "9" * 8),
    (6, "user = bob\nsecret = abcd"),
    (7, "user = bob\n \t\nsecret = abcd"),
    (8, "user = bob" + " " * 201 + "secret = abcd"),
    (9, "user = bob" + " " * 200 + "secret = abcd"),
    (10, "é😀 api-key apikey:12345678 https://x.example/p?token=abcdefgh1 \U0001f511"),
    (11, "0123456789abcdef0 near 10.0.0.1:80"),
    (12, "0123456789012345678 near 10.0.0.1:80"),
    (13, "f" * 31 + "0" + " " + "f" * 32 + "g" + "0a" * 8),
    (14, "token = AKIA12345678"),
    (3, "password: hunter22 and Passwd='abcdefgh' token=short1"),
    (None, "login: root@host server=db.internal passwd=xyzw"),
    (15, "ſecret=abcdefgh1 toKen=abcdefgh1"),
]


def parts_of(text):
    found = []
    for name, pattern in credentials.PATTERNS.items():
        for m in re.finditer(pattern, text):
            size, kind = len(m[0]), None
            if name == "assign":
                kind = 0 if len(m[1]) >= 8 else 3 if len(m[1]) >= 4 else None
            elif name == "access":
                kind = 1 if size >= 16 else 5 if size >= 8 else None
            elif name == "hex":
                kind = 2 if size >= 32 else 6 if re.search("[a-f]", m[0]) and re.search("[0-9]", m[0]) else None
            else:
                kind = {"account": 4, "endpoint": 7}[name]
            if kind is not None:
                found.append((m.start(), kind, m.end()))
    return found


def brute(text, scope=credentials.SCOPE):
    text = text or ""
    parts, out = parts_of(text), []
    breaks = [m.span() for m in re.finditer(credentials.BLANK_LINE, text)]
    for a in parts:
        keep = a[1] < credentials.STRONG
        for b in parts:
            left, right = min(a[2], b[2]), max(a[0], b[0])
            secrets = [credentials.ROLES[p[1]] == "secret" for p in (a, b)]
            if secrets[0] != secrets[1] and 0 <= right - left <= scope:
                keep |= not any(left <= s and e <= right for s, e in breaks)
        if keep:
            out.append(a)
    return sorted(out)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "s", 1, "clash", "clash") for i, t in rows], DOC)


def shown(rows):
    return sorted(((r[0] is None, r[0] or 0), [tuple(s) for s in r[1]]) for r in rows)


def wanted(rows, scope=credentials.SCOPE):
    return sorted(((i is None, i or 0), brute(t, scope)) for i, t in rows)


def random_text(rng):
    bits = ["user: bob ", "secret=abcd ", "token='abcdefgh12' ", "AKIA12345 ", "AKIA" + "Z" * 16 + " ", "a1" * 8 + " ",
            "b2" * 20, "http://h.example/x ", "1.2.3.4 ", "\n\n", "\n", "word ", "é", "password", "=", ":", '"', "token"]
    return "".join(rng.choice(bits) + " " * rng.choice([0, 0, 1, 15]) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("scope", [7, 40, 200])
def test_spans_equal_brute_force(spark, scope):
    rng = random.Random(scope)
    rows = ODD + [(100 + i, random_text(rng)) for i in range(150)]
    rows.append((999, "user: bob secret=abcd\n\n" * 3000))
    found = credentials.find_secrets(docs_of(spark, rows), scope).collect()
    assert shown(found) == wanted(rows, scope)


def test_named_cases(spark):
    found = {i: brute(t) for i, t in ODD if i not in (None, 3)}
    kinds = {i: [credentials.KINDS[s[1]] for s in spans] for i, spans in found.items()}
    assert kinds[4] == []
    assert kinds[5] == ["access"]
    assert kinds[6] == ["account", "short_assign"] == kinds[9]
    assert kinds[7] == [] == kinds[8]
    assert kinds[11] == ["short_hex", "endpoint"] and kinds[12] == []
    assert kinds[14] == ["assign"] and kinds[15] == []
    assert credentials.find_secrets(docs_of(spark, ODD[:0])).collect() == []


def test_query_columns_equal_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = ODD[:-1] + [(100 + i, random_text(rng)) for i in range(60)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    frame = queries.op11_credential_links(spark, str(tmp_path))
    got = sorted(map(repr, (tuple(r) for r in frame.collect())))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}))
    assert got == sorted(map(repr, con.execute(queries.CREDENTIAL_SQL).fetchall()))
    empty = [r for r in frame.collect() if r.doc_id == 1][0]
    assert empty.base_sha256 == hashlib.sha256(b"").hexdigest() and empty.spans == ""
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
