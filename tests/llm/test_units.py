"""Parts of the operators against brute force, without Spark."""

import base64
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from cairnlog.llm import ann, bpe, json_bpe, minhash, packing, pii, quality, sstable, toxicity

ODD = ["", " ", "\n\n", "a", "It's 12,345 naïve ÜBER — 你好 👍🏽\t\tx  y ", "\x85 z\x1c", "<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "ab" * 300, "\r\n \r\n x"]


@pytest.fixture(scope="module")
def multi():
    return bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def library(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(seed, n):
    rng = random.Random(seed)
    alphabet = "etaoin shrdlu\n.,'0123456789ÄÖßéñçøж你 \t　_-#"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_prefix_encoder_equals_library(multi):
    own = library("byte_bpe_multi_50k.tiktoken")
    for text in ODD + noise(1, 150):
        ids = np.frombuffer(multi.encode(text), "<u4").tolist()
        assert ids == own.encode_ordinary(text)
        assert multi.decode(ids) == text.encode()


def test_appends_and_edits_are_exact(multi):
    rng = random.Random(2)
    for _ in range(30):
        piece = bpe.EditablePiece(multi)
        for _ in range(6):
            if rng.random() < 0.5:
                piece.append("".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 9))).encode())
            else:
                a = rng.randrange(len(piece.data) + 1)
                b = min(len(piece.data), a + rng.randrange(4))
                piece.edit(a, b, bytes(rng.choice(b"aehlnt") for _ in range(rng.randrange(4))))
            assert piece.ids() == multi.encode_piece(piece.data)


def test_json_encoder_equals_library():
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc = json_bpe.encoder(P.path("byte_bpe_50k.json"))
    for text in ODD + noise(3, 150):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(map(int, str(2 * int(c)))) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    fits = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if fits[k](m[0])]


def test_base_kinds_equal_their_patterns():
    rng = random.Random(4)
    bits = ["a.b@c.de", "@", "x@y", ".", "-", " ", "+", "4111 1111 1111 1111", "10.0.0.1", "1.2.3.4.5.6.7.8", "300.1.1.1", "+49 (0) 170 1234567", "é", "7", "0", "a@b@c.d", "%", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        assert [s for s in pii.spans(text) if s[0] in BASE] == base_spans(text), text


def test_added_kinds_and_redaction():
    text = "Account no: 12345678, IBAN DE89 3704 0044 0532 0130 00; https://me:pass@host.example/x at 12 Old Mill Road. SSN 123-45-6789"
    assert {k for k, *_ in pii.spans(text)} >= {"account", "iban", "url_login", "address", "ssn"}
    clean = pii.redact_text(text, pii.spans(text))
    assert "12345678" not in clean and "3704" not in clean and "<SSN>" in clean
    assert pii.redact_text("nothing here", pii.spans("nothing here")) == "nothing here"
    assert pii.spans(None) == pii.spans("") == []


def test_addresses_of_four_languages():
    held = {
        "lives at 12 Old Mill Road, so": "12 Old Mill Road", "at 7 High St. and": "7 High St", "AT 99 Main STREET": "99 Main STREET",
        "wohnt Hauptstraße 12a, und": "Hauptstraße 12a", "in der Lange Straße 5.": "Lange Straße 5", "am Mühlweg 3": "Mühlweg 3", "Karl-Marx-Allee 140": "Karl-Marx-Allee 140",
        "Lindenstr. 8": "Lindenstr. 8", "au 12, rue de la Paix et": "12, rue de la Paix", "5 bis avenue Victor Hugo": "5 bis avenue Victor Hugo", "3 rue de l'Église": "3 rue de l'Église",
        "vive en Calle Mayor 12 y": "Calle Mayor 12", "calle de Alcalá, 45": "calle de Alcalá, 45", "Avenida de América nº 3": "Avenida de América nº 3",
    }
    for text, span in held.items():
        assert [text[a:b] for k, a, b in pii.spans(text) if k == "address"] == [span], text
    for text in ("a long road", "5 Streets", "rue de la Paix", "true 5", "Weg 3", "auf dem weg 3", "la calle 3", "calle Mayor", "Platzhalter 3", "Hauptstraße", "Version 1.5 avenue Foch", "Mühlweg 3.5"):
        assert not [s for s in pii.spans(text) if s[0] == "address"], text


def test_long_secrets_and_logins():
    jwt = "eyJhbGciOiJIUzI1NiJ9." + "a1" * 300 + ".c2lnbmF0dXJlMTIz"
    for text, kind, span in ((f"token: {jwt} end", "secret", jwt), ("token=abcd1234efgh5678. Next", "secret", "abcd1234efgh5678"), (f"https://me:{'p' * 500}@host.example/", "url_login", "me:" + "p" * 500)):
        assert [text[a:b] for k, a, b in pii.spans(text) if k == kind] == [span]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 3000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (minhash.sketch(x) != np.uint64(2**64 - 1)).all()
    off = []
    for _ in range(60):
        both = rng.integers(0, 2**63, 360).astype(np.uint64)
        a, b = both[:324], both[36:]  # 288 of 360: 0.8
        off.append((minhash.sketch(a) == minhash.sketch(b)).mean() - 0.8)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def test_rotation_keeps_lengths_and_spreads():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(ann.rotate(x, 0, 1), axis=1), 1)
    assert len(np.unique(ann.axes(x, 0, 1, 1))) > 100


def test_packer_holds_every_id_once():
    rng = random.Random(7)
    packer, docs, rows = packing.Packer(0, (64, 32, 16)), {}, []
    for d in range(200):
        ids = np.array([rng.randrange(1000) for _ in range(rng.choice([1, 3, 20, 63, 64, 65, 300]))], "<u4").tobytes()
        docs[d] = ids
        packer.add(d, ids)
        if d % 50 == 49:
            rows += packer.flush()
    rows += packer.flush(last=True)
    got = {d: b"" for d in docs}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        assert len(got[r[0]]) == 4 * r[1] and len(r[8]) == 4 * r[2] and r[3] == len(docs[r[0]]) // 4
        got[r[0]] += r[8]
    assert got == docs
    held = {}
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        assert r[5] == held.get(r[4], 0)
        held[r[4]] = r[5] + r[2]
    padded = sum(n if n & (n - 1) == 0 else 64 for n in held.values())
    assert max(held.values()) <= 64 and padded <= 1.03 * sum(len(v) // 4 for v in docs.values())


def test_shard_round_trip_lookup_and_damage():
    writer, docs = sstable.Writer(2), [(None, b"\x01\x00"), *((i * 3 - 50, bytes(2 * (i % 7))) for i in range(9000))]
    data = b""
    for d, v in docs:
        data += b"".join(s + b"\n" for s in writer.add(d, v))
    data += b"".join(s + b"\n" for s in writer.finish())
    shard = sstable.Shard.of(data)
    assert list(shard.all()) == docs and len(shard.blocks) > 2 and shard.docs == len(docs)
    assert shard.get(-50) == [b""] and shard.get(-49) == [] and shard.get(None) == [b"\x01\x00"] and shard.get(docs[-1][0]) == [docs[-1][1]]
    assert sum(shard.may_hold(sstable.key_of(i * 3 - 49)) for i in range(9000)) < 0.03 * 9000
    bad = bytearray(data)
    bad[10] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Shard.of(bytes(bad)).all())


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(8)
    grades = rng.integers(0, toxicity.GRADES, 800)
    rows = [{0: float(g) + 0.3 * rng.standard_normal()} if g else {1: 1.0} for g in grades]
    model = toxicity.fit(rows, grades, {"bad": 0, "fine": 1})
    assert (np.diff(model.thresholds) > 0).all()
    expected = model.grades(rows).sum(1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


def test_votes_follow_neighbours():
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abcdef ") if y else list("uvwxyz#"), 80)) for y in (0, 1) for _ in range(40)]
    model = quality.fit([quality.term_counts(t) for t in texts], [0] * 40 + [1] * 40, (40, 40))
    s = model.score(np.vstack([quality.term_counts(t) for t in [*texts, ""]]))
    assert s[:40].max() < 0.3 < 0.7 < s[40:80].min() and s[80] == 0.5
    assert quality.fit([], [], (0, 0)).score(np.zeros((2, quality.TERMS), np.float32)).tolist() == [0.5, 0.5]
