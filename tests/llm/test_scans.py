import random
import re
import string
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliograph.llm import licenses, secrets
from tests.llm.helpers import clashing, docs, rows


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["CC", "by", "general", "Public", "license", "all", "rights", "reserved", "-", ".", "\n", "é", "x1"]), max_size=30).map(" ".join))
def test_phrases(text):
    words = brute_words(text)
    n, hits, _ = licenses.scan(text.encode())
    expected = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    assert n == len(words)
    assert sorted((h["word"], h["label"]) for h in hits if h["base"]) == sorted(expected)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([w for phrase in licenses.NOTICES for w in phrase.split()] + list(licenses.NOTICES) + ["x", "\n"]), max_size=20).map(" ".join))
def test_notices(text):
    words = brute_words(text)
    _, hits, _ = licenses.scan(text.encode())
    expected = [(i, label) for phrase, label in licenses.NOTICES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    assert sorted((h["word"], h["label"]) for h in hits if not h["base"]) == sorted(expected)


def brute_expression(line):
    """The longest beginning, by words, that a recursive grammar accepts."""
    parts = re.findall(r"[A-Za-z0-9.+:-]+|[()]", line)

    def operand(i):
        if i < len(parts) and parts[i] == "(":
            j = chain(i + 1)
            return j + 1 if j is not None and j < len(parts) and parts[j] == ")" else None
        return i + 1 if i < len(parts) and parts[i] != ")" and parts[i].upper() not in ("AND", "OR", "WITH") else None

    def chain(i):
        i = operand(i)
        while i is not None and i < len(parts) and parts[i].upper() in ("AND", "OR", "WITH"):
            i = operand(i + 1)
        return i

    for n in range(len(parts), 0, -1):
        full, parts = parts, parts[:n]
        if chain(0) == n:
            return " ".join(parts)
        parts = full
    return None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "GPL-2.0", "and", "OR", "WITH", "(", ")"]), max_size=12).map(" ".join))
def test_longest_expression(line):
    got = licenses.expression(line)
    assert (got and got[0]) == brute_expression(line)


def test_long_license_texts():
    start = time.time()
    n, hits, _ = licenses.scan(b"cc by " * 850_000)  # 5 MB
    assert n == 1_700_000 and len(hits) == 850_000 and hits[-1]["word"] == n - 2
    assert licenses.expression("(" * 100_000) is None
    assert licenses.expression(" and ".join(f"L{i}" for i in range(50_000)))[1][0] == "l0"
    assert time.time() - start < 30


@pytest.mark.parametrize("line, names, asks", [
    ("MIT", ["mit"], "permissive"),
    ("MIT OR GPL-3.0-only", ["gpl-3.0-only", "mit"], "permissive"),
    ("MIT AND GPL-3.0-only", ["gpl-3.0-only", "mit"], "strong"),
    ("MIT OR Apache-2.0 AND GPL-2.0-only", ["apache-2.0", "gpl-2.0-only", "mit"], "permissive"),
    ("(MIT OR Apache-2.0) AND GPL-2.0-only", ["apache-2.0", "gpl-2.0-only", "mit"], "strong"),
    ("GPL-2.0-only WITH Classpath-exception-2.0", ["gpl-2.0-only"], "weak"),
    ("MIT or", ["mit"], "permissive"),
    ("MIT */", ["mit"], "permissive"),
    ("Foo-1.0", ["foo-1.0"], "unknown"),
])
def test_expressions(line, names, asks):
    assert licenses.expression(line)[1:] == (names, asks)


def test_no_expression():
    assert licenses.expression("") is None and licenses.expression("(") is None and licenses.expression("AND MIT") is None


def test_license_scan_of_odd_rows(spark):
    got = licenses.license_scan(clashing(docs(spark))).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(d), len(brute_words(t))) for d, t, *_ in rows())
    assert licenses.license_scan(docs(spark, [])).count() == 0


def brute_spans(text):
    out = []
    assign = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, (pattern, group, least) in enumerate(((assign, 1, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16))):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "apikey", "api_key", "ſecret", "Key", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH12", "deadbeef", "0123456789abcdef", "é", "漢", "\n", "x_y.z-", "AB"]), max_size=25).map("".join))
def test_base_spans(text):
    got = [(s["start"], s["kind"], s["end"]) for s in secrets.scan(text.encode()) if s["kind"] < 3]
    assert got == brute_spans(text)


def test_novelty():
    text = "the secret of the orchestration is in the token of the conversationalists; client key Xk29fjKq02LmZpQ8vTr4u ok"
    found = [text[s["start"] : s["end"]] for s in secrets.scan(text.encode())]
    assert found == ["Xk29fjKq02LmZpQ8vTr4u"]


ALPHABETS = {
    "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "base36": string.ascii_lowercase + string.digits,
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567",
    "hex": "0123456789ABCDEF",
}
PROSE = "the river ran by the old house where the children of the village had gone to read their letters in the evening light "


@pytest.mark.parametrize("letters", ALPHABETS.values(), ids=ALPHABETS.keys())
@pytest.mark.parametrize("length", [16, 24, 64])
def test_planted_secrets_are_found(letters, length):
    rng = random.Random(f"{letters}{length}")
    found = 0
    for _ in range(40):
        own = "".join(rng.choices(letters, k=length))
        words = PROSE.split() * 4
        rng.shuffle(words)
        text = f"{' '.join(words)} {rng.choice(('credential', 'private key', 'Bearer'))} {own} {PROSE}"
        found += any(text[s["start"] : s["end"]] == own for s in secrets.scan(text.encode()))
    assert found >= 36  # recall of 0.9


def test_words_and_identifiers_are_left_alone():
    names = "getAuthorizationHeader private_key_password_file credentials_provider_factory CLIENT_SECRET_ENVIRONMENT accessKeyIdentifier internationalization responsibilities".split()
    text = PROSE * 3 + "".join(f"the credential {n} of the token {n} is read; " for n in names)
    assert secrets.scan(text.encode()) == []


def brute_candidates(text):
    """For every run of key characters all sensitive words are tried."""
    words = [m.span() for m in secrets._SENSITIVE.finditer(text.lower())]
    out = []
    for m in secrets._CANDIDATE.finditer(text):
        starts = [m.start()] if any(0 <= m.start() - e <= secrets.NEAR for _, e in words) else [e for s, e in words if e > m.start() and s < m.end()][:1]
        out += [(s, m.end()) for s in starts if m.end() - s >= secrets.SHORTEST and (m.end() - s >= secrets.WORDLIKE or not secrets._WORD.fullmatch(text, s, m.end()))]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "client_key", "Bearer ", "abcdefgh", "XK29fjkqLmZp", "0123456789", " ", "\n", "é" * 30, "x" * 40]), max_size=20).map("".join))
def test_candidates(text):
    data = text.encode()
    assert secrets.candidates(data, data.lower()) == brute_candidates(data)


def test_novelty_by_definition():
    """A candidate's share of what its random strings add, over both orders of the surroundings."""
    data = (PROSE + "credential Xk29fjKq02LmZpQ8vTr4u and then " + PROSE).encode()
    start = data.index(b"Xk29")
    end = start + 21
    own, sides = data[start:end], [data[max(0, start - 1024) : start] + b" ", data[end : end + 1024] + b" "]
    added = expected = 0
    for around in (sides[0] + sides[1], sides[1] + sides[0]):
        size = lambda t: len(secrets._compressor().compress(secrets._KNOWN + around + t))  # noqa: B023, E731
        added += size(own) - size(b"")
        expected += sum(size(secrets.drawn(own, k)) - size(b"") for k in range(secrets.DRAWS)) / secrets.DRAWS
    assert secrets.novelty(data, start, end) == pytest.approx(added / expected)
    for k in range(20):
        shape = lambda t: re.sub(rb"[0-9]", b"9", re.sub(rb"[a-z]", b"a", re.sub(rb"[A-Z]", b"A", t)))
        assert shape(secrets.drawn(own, k)) == shape(own)


def test_long_secret_texts():
    start = time.time()
    assert secrets.scan(b"token " * 175_000) == []  # 1 MB
    assert len(secrets.scan(b"token=abcdefghijklmnop " * 45_000)) == 45_000
    secrets.scan(b"a" * 2_000_000 + b" token " + b"Zq3" * 300_000)
    assert time.time() - start < 20


def test_secret_scan_of_odd_rows(spark):
    got = secrets.secret_scan(clashing(docs(spark))).collect()
    assert len(got) == len(rows()) and secrets.secret_scan(docs(spark, [])).count() == 0
