import base64
import gzip
import re
import zlib
from hashlib import sha256
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import secrets

from .helpers import ODD, table

PW = "password=hunter2hunter2"


def b64(x: bytes) -> str:
    return base64.b64encode(x).decode()


@pytest.mark.parametrize(
    "wrapped",
    [
        quote(PW, safe=""), quote(quote(PW, safe=""), safe=""), "".join(f"\\u{ord(c):04x}" for c in PW), "".join(f"\\x{ord(c):02x}" for c in PW), "".join(f"%{ord(c):02X}" for c in PW),
        b64(PW.encode()), b64(b64(PW.encode()).encode()), b64(gzip.compress(PW.encode())), b64(zlib.compress(b64(gzip.compress(quote(PW, safe="").encode())).encode())), "\\u{70}assword\\u003dhunter2hunter2",
    ],
)
def test_layers_map_to_the_original(wrapped):
    text = f"é {wrapped} tail"
    found = secrets.scan_text(text)
    assert found and all(not base for *_, base in found)
    assert min(a for a, *_ in found) >= 2 and max(b for _, _, b, _ in found) <= 2 + len(wrapped)
    assert "hunter2" not in secrets.redact_text(text) and secrets.redact_text(text).endswith(" tail")


def wrap(s: str, width: int, end: str = "\n") -> str:
    return end.join(s[i : i + width] for i in range(0, len(s), width))


@pytest.mark.parametrize("payload", [f"\ufeff{PW}".encode(), f"{PW}\u00a0\u200b".encode(), b"\x00" + PW.encode(), PW.encode() + b" \xe9\xff", b"x " + PW.encode(), b"x?" + PW.encode(), b"x^" + PW.encode()])
def test_base64_of_any_bytes(payload):
    text = f"see {b64(payload)} end"
    assert secrets.scan_text(text) == [(4, 0, len(text) - 4, False)]


def test_shortest_base64():
    assert secrets.scan_text("a " + b64(b"token=12345678")) == [(2, 0, 22, False)]
    assert secrets.scan_text("a " + b64(b"token=12345678").rstrip("=")) == [(2, 0, 21, False)]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  ", "\n> "])
def test_base64_over_line_breaks(end):
    noise = "".join(sha256(str(i).encode()).hexdigest()[:20] + " \n" for i in range(40))
    for width in (64, 76):
        for n in range(30, 90, 7):
            wrapped = wrap(b64(("é" * (n % 3) + "." * n + PW + " ." * 50).encode()), width, end)
            text = f"word\n{wrapped}\nThe end"
            found = secrets.scan_text(text)
            assert found and all(5 <= a and b <= 5 + len(wrapped) for a, _, b, _ in found), (width, n)
        for packed in (gzip.compress((noise + PW).encode()), zlib.compress((noise + PW).encode())):
            wrapped = wrap(b64(packed), width, end)
            assert (5, 0, 5 + len(wrapped), False) in secrets.scan_text(f"word\n{wrapped}\nThe end")
    twice = wrap(b64(("." * 40 + PW).encode()), 64)
    found = secrets.scan_text(f"{twice}; {twice}")
    assert {a < len(twice) for a, *_ in found} == {True, False}


def test_base_rules():
    cases = {
        "password: abcdefgh": [(0, 0, 18)], "password: abcdefg": [], "PassWd=\"abcdefgh\"": [(0, 0, 16)], "api-key=abcdefgh": [], "apikey=abcdefgh": [(0, 0, 15)], "API_KEY = 'abcdefgh'": [(0, 0, 19)],
        "ſecret=abcdefgh": [], "toKen=abcdefgh": [(0, 0, 14)], "AKIA" + "A" * 12: [(0, 1, 16)], "AKIA" + "A" * 11: [], "f" * 31: [], "f" * 32: [(0, 2, 32)], "token=" + "a1" * 20: [(0, 0, 46), (6, 2, 46)],
    }
    for text, want in cases.items():
        assert [s[:3] for s in secrets.scan_text(text) if s[3]] == want, text


def test_cycles_and_large_payloads_end():
    assert secrets.scan_text("%25" * 2000) == []
    huge = b64(gzip.compress(b"x" * 3_000_000 + PW.encode() + b"y" * 3_000_000))
    assert secrets.scan_text(huge, window=100_000) == [(0, 0, len(huge), False)]
    assert secrets.scan_text(b64(b"\x1f\x8bnot gzip at all.......")) == []


def test_windows_cut_nothing():
    noise = "".join(f"{sha256(str(i).encode()).hexdigest()[:25]} é " for i in range(6000))
    inner = b64(gzip.compress((noise + PW).encode()))
    assert len(inner) > 100_000
    for window in (20_000, 30_011):
        for fill in (0, 7_001, 19_990, 30_003):
            outer = b64(gzip.compress(("é " * (fill // 3) + "." * (fill % 3) + " " + inner + " end").encode()))
            assert secrets.scan_text(outer, window=window) == [(0, 0, len(outer), False)], (window, fill)
    for fill in range(990, 1010):
        outer = b64(zlib.compress(("é" * 3 + "- " * (fill // 2) + "." * (fill % 2) + " password = 'hunter2hunter2' end" + " x" * 900).encode()))
        assert secrets.scan_text(outer, window=1000) == [(0, 0, len(outer), False)], fill


def test_all_members():
    for members in ((b"one", b"two", PW.encode()), (PW[:12].encode(), PW[12:].encode()), (b"", b"x" * 200_000, PW.encode() + b" ")):
        outer = b64(b"".join(map(gzip.compress, members)))
        assert secrets.scan_text(outer, window=1000) == [(0, 0, len(outer), False)]
        lines = wrap(outer, 76)
        assert secrets.scan_text(lines)


def test_query(spark, tmp_path):
    texts = [*ODD, f"{PW} and AKIA{'B' * 16}", f"see {b64(PW.encode())}", PW + " " + PW, "f" * 40]
    docs = table(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in secrets.op8_secrets(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = sorted(secrets.base_spans(t or ""))
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == sha256(told.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert set(filter(None, told.split(","))) <= set(got[i].spans.split(","))
    assert got[len(ODD) + 1].spans == "assign:4:36" and got[len(ODD) + 1].n_assign == 0
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert all(clean[i].text == texts[i] for i in range(len(ODD))) and clean[len(ODD) + 2].text == "[SECRET] [SECRET]"
    assert secrets.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("before", ["blob/", "k-", "a_b-", "data+/", "x/yy/zzz/", "aaaa/bbb/"])
def test_base64_behind_other_signs(before):
    for payload in (PW.encode(), gzip.compress(PW.encode()), PW.encode("utf-16-le"), b"\xff\xfe" + PW.encode("utf-16-be")):
        for encoded in (b64(payload), base64.urlsafe_b64encode(payload).decode().rstrip("=")):
            text = f"see {before}{encoded} end"
            found = secrets.scan_text(text)
            assert found and all(4 <= a <= 4 + len(before) and b == len(text) - 4 for a, _, b, _ in found), text


def test_runs_with_bad_bytes():
    for text in ("password%3D%FFhunter2hunter2", "password%3Dhunter2hunter2%C3", "%E9password%3Dhunter2hunter2", "\\ud800password\\u003dhunter2hunter2"):
        found = secrets.scan_text(text)
        assert bool(found) == ("%FFhunter" not in text), text


def _layers(text):
    """All that a text unwraps to, by the plainest means: every token at every offset, every run of escapes, over and over."""
    seen, todo = set(), [text]
    while todo:
        t = todo.pop()
        if t in seen:
            continue
        seen.add(t)
        todo.append(re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"), t))
        todo.append(re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), t))
        todo.append(t.replace("\0", "") if "\0" in t else t)
        for body in {*re.findall(r"[A-Za-z0-9+/_-]{19,}", t), *(re.sub(r"[\n ]", "", m) for m in re.findall(r"[A-Za-z0-9+/_-]+(?:\n[A-Za-z0-9+/_-]+)+", t))}:
            for at in [0, *(m.end() for m in re.finditer(r"[+/_-]", body))]:
                part = body[at:]
                if len(part) < 19:
                    continue
                part = part[: len(part) - (len(part) % 4 == 1)].translate(str.maketrans("-_", "+/"))
                data = base64.b64decode(part + "=" * (-len(part) % 4))
                todo.append(data.decode("utf-8", "surrogateescape"))
                for bits in (31, 15):
                    try:
                        todo.append(zlib.decompressobj(bits).decompress(data).decode("utf-8", "surrogateescape"))
                    except zlib.error:
                        pass
    return seen


def _escaped(x: bytes) -> bytes:
    return "".join(f"\\u{ord(c):04x}" for c in x.decode("latin-1")).encode()


WRAPPERS = {
    "url": lambda x: quote(x, safe="").encode(), "all": lambda x: "".join(f"%{c:02x}" for c in x).encode(), "unicode": _escaped, "base64": base64.b64encode, "bare": lambda x: base64.urlsafe_b64encode(x).rstrip(b"="),
    "gzip": lambda x: base64.b64encode(gzip.compress(x)), "zlib": lambda x: base64.b64encode(zlib.compress(x)), "path": lambda x: b"blob/" + base64.b64encode(x), "lines": lambda x: wrap(base64.b64encode(x).decode(), 24).encode(),
}


@given(st.lists(st.sampled_from(sorted(WRAPPERS)), max_size=3), st.sampled_from([PW, "token=abcd1234", "x AKIA" + "Q" * 16 + " y", "just some words of prose", "0123456789abcdef" * 2, "passwd=short"]), st.sampled_from(["", "word ", "é:\n"]))
@settings(max_examples=250, deadline=None)
def test_equals_the_plainest_unwrapping(wrappers, payload, before):
    data = payload.encode()
    for w in wrappers:
        data = WRAPPERS[w](data)
    text = f"{before}{data.decode()} end"
    want = any(secrets.base_spans(t) for t in _layers(text))
    found = secrets.scan_text(text)
    assert bool(found) == want, (wrappers, payload)
    assert all(len(before) <= a < b <= len(text) - 3 for a, _, b, _ in found)
    assert found == secrets.scan_text(text, window=64)


def test_bounded_work():
    """Layers are unwrapped one at a time: what is held at once doesn't grow with what a payload unpacks to."""
    import tracemalloc

    held = []
    for n in (2_000_000, 16_000_000):
        packed = b64(gzip.compress(b"some words here " * (n // 16) + PW.encode()))
        tracemalloc.start()
        assert secrets.scan_text(packed, window=200_000)
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert held[1] < 2 * held[0] and held[1] < 12_000_000
