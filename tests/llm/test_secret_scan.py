import hashlib
import random
import re
import string
import time

from brute import secrets
from hypothesis import given, settings
from hypothesis import strategies as st
from stratalog.llm.secret_scan import AROUND, SENSITIVE, base_spans, is_novel, novel_spans, novelty, render, scan, secret_scan

KEY = "q7Zp0Xv93LkTbR1mWc8Yd2Hs"


def test_base_spans():
    for text in ('password = "abc12"', "PassWord:'abcdef", "api_key=ABCDEF token: x secret=......", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "a", "é" * 3 + "0" * 24 + "g" + "f" * 23, "toKen=abcdefg", "token=token=abcdef", "apikey = = abcdef", "ſecret=abcdefgh"):
        assert render(base_spans(text)).split(",") == (secrets(text) or [""]), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "=", ":", " ", '"', "AKIA", "AB12", "deadbeef", "0a", "x", "é", "-", "secret"]), max_size=30).map("".join))
def test_any_text(text):
    assert render(base_spans(text)).split(",") == (secrets(text) or [""])


def test_novel_spans():
    assert scan(f"the token is {KEY} here")["n_novel"] == 1
    assert scan(f"the word is {KEY} here")["n_novel"] == 0  # nothing sensitive near
    assert scan("the token is access_token_client_secret_2 here")["n_novel"] == 0  # identifiers
    assert scan(f"{KEY} {KEY} token {KEY} end")["n_novel"] == 0  # seen around it
    assert novelty(KEY, "") > 0.7 > novelty(KEY, "x " + KEY)


def test_rows(docs):
    rows = [(1, None), (2, ""), (3, "password=hunter22"), (3, "password=hunter22"), (None, "x"), (4, "token " + string.ascii_letters * 5000)]
    out = {r.doc_id: r for r in secret_scan(docs(rows)).collect()}
    assert out[1].base_sha256 == out[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[3].spans == "assign:0:17" and out[3].n_assign == 1
    assert secret_scan(docs(rows)).count() == 6 and secret_scan(docs([])).count() == 0


def test_table(table):
    for r in table("documents").join(secret_scan(table("documents")), "doc_id").collect():
        want = secrets(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) and r.n_assign + r.n_access + r.n_hex == len(want)


def test_keys_of_any_alphabet_on_either_side():
    rng = random.Random(7)
    for letters in ("0123456789ABCDEF", string.digits, string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits, "0123456789ABCDEF-"):
        for n in (24, 88, 128, 512):
            keys = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(20)]
            for k in keys:
                far = " some more of the text" * 15
                for text in (f"bearer {k} end", f"bearer{far} {k} end", f"a {k} is{far} the credential"):
                    assert scan(text)["n_novel"] + scan(text)["n_hex"] >= 1, (text, letters)
    for text in ("token " + "=" * 40, "token " + "-=" * 5_000, "token " + string.ascii_letters * 5_000, "secret 1111111111111111"):
        assert scan(text)["n_novel"] == 0, text[:40]


def test_very_long_texts_take_time_in_proportion():
    began = time.process_time()
    scan("token of mine " * 200_000)
    scan("token" * 20_000 + " " + "secret_" * 100_000)
    assert time.process_time() - began < 60


def novel_plainly(text):
    """Every run of key-like characters against every sensitive word and base span."""
    base, words, out = base_spans(text), [m.span() for w in SENSITIVE for m in re.finditer(w, text, re.IGNORECASE | re.ASCII)], []
    for run in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        if not any(s <= run.end() + AROUND and e >= run.start() - AROUND for s, e in words):
            continue
        inside = sorted(w for w in words if w[0] < run.end() and w[1] > run.start())
        cuts = [run.start(), *(x for w in inside for x in w), run.end()]
        parts = [m.span() for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text[:b]) if m.start() >= a] if not inside else [
            (a + m.start(), a + m.end()) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text[a:b])
        ]
        for s, e in parts or [run.span()]:
            if not any(x < e and y > s for x, y, _ in base) and is_novel(text[s:e], text[max(0, s - AROUND) : s] + " " + text[e : e + AROUND]):
                out.append((s, e, "novel"))
    return out


def test_novel_spans_against_a_plain_version(table):
    rng = random.Random(3)
    key = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randrange(10, 60)))
    texts = [r.text for r in table("documents").collect()]
    texts += [" ".join(rng.choice(["a word", "token", "my-secret-is", f"x{key()}", key(), f"password={key()}", "q " * rng.randrange(300), f"{key()}token{key()}"]) for _ in range(40)) for _ in range(60)]
    found = 0
    for t in texts:
        assert novel_spans(t, base_spans(t)) == novel_plainly(t)
        found += len(novel_plainly(t))
    assert found > 50
