"""Word hashes, token ids, boxes, files and patterns against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import media, packing, pii, secret_scan, token_files
from quadrille.llm import words as W
from quadrille.llm.arrow import flat
from quadrille.llm.tokens import encoder, tokenizer_path, with_end


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


RULES = [(W.PLAIN, r"[^\x20\x09-\x0D]+", False), (W.LOWER, r"[^\x20\x09-\x0D]+", True), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)]


@pytest.mark.parametrize(("rule", "pattern", "lower"), RULES)
def test_words_and_runs(rule, pattern, lower):
    rng = random.Random(2)
    texts = [None, "", *("".join(rng.choice(["a", "A", "b", " ", "  ", "\n", "é", "É", "-", "1"]) for _ in range(rng.randint(0, 30))) for _ in range(400))]
    words = W.split(*flat(pa.array(texts)), rule)
    expected = [re.findall(pattern, low(t or "") if lower else t or "") for t in texts]
    assert words.counts.tolist() == [len(x) for x in expected]
    for k in (1, 2, 5):
        h, first = W.run_hashes(words, k)
        runs = [tuple(x[i : i + k]) for x in expected for i in range(len(x) - k + 1)]
        assert len(runs) == len(h) and len(set(zip(runs, h.tolist(), strict=True))) == len(set(runs)) == len(set(h.tolist()))
        ends = [(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
        assert W.window_minima(h, first, 4).tolist() == [i + int(np.argmin(h[i : i + 4] >> np.uint64(16))) for a, b in ends for i in range(a, b - 3)]


def test_ids_are_those_of_the_library():
    rng = random.Random(1)
    parts = ["a", "S", "'", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "é", "ß", "1", "½", "-", "’", "漢", "😀", "<|endoftext|>", "\x1c", "\x85", "​", "Ж", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    e = encoder(tokenizer_path())
    assert e.fast
    expected = [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
    for i, j, ids, at in e.encode(pa.array(texts)):
        assert [ids[at[r] : at[r + 1]].tolist() for r in range(j - i)] == expected[i:j]
    ids, at = with_end(np.array([7, 8, 9], np.uint32), np.array([0, 2, 2, 3]))
    assert ids.tolist() == [7, 8, 2, 2, 9, 2] and at.tolist() == [0, 3, 4, 6]


def test_other_tokenizers_are_used_whole():
    e = encoder(tokenizer_path("word_bpe_49k.json"))
    assert not e.fast
    ((_, _, ids, at),) = e.encode(pa.array(["Hello there", "", None]))
    assert ids[: at[1]].tolist() == e.library.encode("Hello there", add_special_tokens=False).ids and at[1] == at[3]


@pytest.mark.parametrize("n", [1, 15, 16, 17, 31, 32, 33, 64, 1000])
def test_media_round_trip(n):
    payload = random.Random(n).randbytes(64 * n)
    raw = media.encode(payload)
    (t,) = media.tracks(raw)
    assert media.stored_payload(raw, t) == payload
    at, size = t.keyframes()
    assert [raw[a : a + s] for a, s in zip(at, size, strict=True)] == [payload[i : i + 64] for i in range(0, len(payload), 64 * media.GROUP)]
    assert (t.codec, t.duration, t.timescale, t.handler) == ("raw ", n, media.TIMESCALE, "vide")
    with pytest.raises(media.MalformedMedia):
        media.tracks(raw[: len(raw) // 2])


def test_media_tables_in_other_forms():
    """64-bit boxes, sizes by sample, runs of chunks, no sync table, and a last box that runs to the end."""
    import struct

    full = media._full
    sizes, per = [3, 5, 7, 2, 4], [2, 2, 1]
    offsets = [100, 50, 200]
    table = media._box(b"stbl", full(b"stsd", 0, 0, struct.pack(">I", 1), media._box(b"mp4a", bytes(28))), full(b"stsc", 0, 0, struct.pack(">I", 2), struct.pack(">3I", 1, 2, 1), struct.pack(">3I", 3, 1, 1)), full(b"stsz", 0, 0, struct.pack(">2I", 0, 5), struct.pack(">5I", *sizes)), full(b"co64", 0, 0, struct.pack(">I", 3), struct.pack(">3Q", *offsets)))
    head = full(b"mdhd", 1, 0, struct.pack(">2QIQ", 0, 0, 48000, 1 << 33))
    body = media._box(b"trak", media._box(b"mdia", head, media._box(b"minf", table)))
    raw = struct.pack(">I4sQ", 1, b"moov", len(body) + 16) + body + struct.pack(">I4s", 0, b"mdat") + b"rest"
    (t,) = media.tracks(raw)
    assert (t.codec, t.timescale, t.duration) == ("mp4a", 48000, 1 << 33)
    at, size = t.keyframes()
    expected, k = [], 0
    for o, n in zip(offsets, per, strict=True):
        for _ in range(n):
            expected.append(o)
            o, k = o + sizes[k], k + 1
    assert at.tolist() == expected and size.tolist() == sizes
    assert media._described(b"junk!junk!")["error"] and media._described(None)["error"] == "null" and media._described(b"")["tracks"] == []


def test_token_file_reads_single_documents(tmp_path):
    rng = np.random.default_rng(0)
    documents = [(i if i else None, rng.integers(0, 50_000, rng.integers(0, 900)).astype("<u4")) for i in range(60)]
    raw = token_files.in_memory(documents, frame_ids=2000)
    path = tmp_path / "x.zst"
    path.write_bytes(raw)
    got = token_files.read_documents(f"file://{path}", {7, 33, 999})
    assert set(got) == {7, 33} and all(np.array_equal(got[k], documents[k][1]) for k in got)
    damaged = bytearray(raw)
    damaged[20] ^= 255
    path.write_bytes(bytes(damaged))
    with pytest.raises(token_files.DamagedFile):
        token_files.read_documents(f"file://{path}", {1})
    assert 33 in token_files.read_documents(f"file://{path}", {33})  # other frames are still good
    path.write_bytes(raw[:-3])
    with pytest.raises(token_files.DamagedFile):
        token_files.read_documents(f"file://{path}", {33})


def test_cut_and_packing_of_lengths():
    row, start, size = packing.cut(np.array([1, 1024, 1025, 2500]), 1024)
    assert list(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)) == [(0, 0, 1), (1, 0, 1024), (2, 0, 1), (2, 1, 1024), (3, 0, 452), (3, 452, 1024), (3, 1476, 1024)]
    rng = np.random.default_rng(3)
    lengths = Counter(rng.integers(1, 1024, 3000).tolist())
    found = packing.evolve(lengths, [], np.random.default_rng(1))
    held = Counter()
    for x, n in found.items():
        assert sum(x) <= 1024
        for y in x:
            held[y] += n
    assert held == lengths
    least = -(-sum(x * n for x, n in lengths.items()) // 1024)
    assert sum(found.values()) <= 1.01 * least
    assert sum(packing.evolve(Counter({600: 4, 424: 4}), [], rng).values()) == 4
    child = packing.crossover(found, packing.best_fit(lengths, Counter(), 1024), lengths, rng, 1024)
    assert sum(n * len(x) for x, n in child.items()) == sum(lengths.values())


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    n = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span(), True) for m in EMAIL.finditer(t)] + [("ip", *m.span(), True) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span(), True) for m in CARD.finditer(t) if 14 <= len(n(m)) <= 19 and pii.luhn(n(m))] + [("phone", *m.span(), True) for m in PHONE.finditer(t) if 10 <= len(n(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_personal_data():
    rng = random.Random(1)
    parts = ["a", "b.", "@", "@c", ".", "_", "-", "+", "1", "23", "255", "0999", "4539 1488 0343 6467", " ", "(", "é", "\n", "+1 (988) 555-2485"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(t) == brute_pii(t)
    assert pii.base_spans("9" * 50_000 + ".1.2.3") == [] and pii.base_spans("0" * 5000 + ".1.2.3")[0][0] == "ip"


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_base_secrets():
    rng = random.Random(1)
    parts = ["password", "ToKen", "api_key", "APIKEY", "ſecret", "secret", "=", ": ", '"', "'", "AKIA", "ABCDEF12", "abcdef0123", "g", "é", " ", "\n", "xyzw", "0f", "\x00"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        out = [("assign", *m.span(), True) for m in ASSIGN.finditer(t) if len(m[2]) >= 12] + [("access", *m.span(), True) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [("hex", *m.span(), True) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert secret_scan.base_spans(t) == sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_automata_tell_formats():
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40]))) for _ in range(200)]
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(200)]
    plain = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(3, 18))) for _ in range(400)]
    m = secret_scan.Model({"hex": secret_scan.infer(hexes), "access": secret_scan.infer(keys)}, secret_scan.Ordinary(plain))
    assert m.automata["access"].head == 4
    fresh = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(50)]
    assert sum(m.kind_of(x) == "hex" for x in fresh) >= 45
    assert sum(m.kind_of("AKIA" + x[4:]) == "access" for x in ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(50)]) >= 45
    assert not any(m.kind_of(x) for x in [*plain, "https://example.com/page2.html", "mail8.example.com", "version-2.0.1-beta-release"])


def test_field_finds_spans_it_was_shown():
    rng = random.Random(6)
    texts = [f"call {rng.choice(['me', 'us'])} at +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or write x{i}@mail{i}.example.com about {rng.randint(1, 99)} things" for i in range(60)]
    both = [x for t in texts[:40] for x in pii.labelled(t)]
    field = pii.Field()
    field.learn([x for x, _ in both], [g for _, g in both])
    right = total = wrong = 0
    for t in texts[40:]:
        for lattice, gold in pii.labelled(t):
            got, expected = set(field.decode(lattice)), {(*lattice.spans[s], k) for s, k in gold.items()}
            right, total, wrong = right + len(got & expected), total + len(expected), wrong + len(got - expected)
    assert right >= 0.9 * total and wrong <= 0.1 * total
    assert pii.Field().decode(pii.Lattice("no digits", [(0, 2)])) == []


def test_decoding_is_the_best_of_all_labellings():
    """Dynamic programming against every labelling of a short text."""
    text = "a1 2"
    (_, tokens), = pii.stretches(text)
    lattice = pii.Lattice(text, tokens)
    field = pii.Field()
    rng = np.random.default_rng(0)
    field.weights, field.follows = rng.normal(size=field.weights.shape), rng.normal(size=field.follows.shape)
    score = lattice.x @ field.weights

    def all_from(i, before):
        if i == lattice.n:
            yield 0.0, []
            return
        for s, rest in all_from(i + 1, 0):
            yield s + field.follows[before, 0], rest
        for k, (a, b) in enumerate(lattice.spans):
            if a == i:
                for y in range(len(pii.KINDS)):
                    for s, rest in all_from(b, y + 1):
                        yield s + field.follows[before, y + 1] + score[k, y], [(a, b, y), *rest]

    every = list(all_from(0, 0))
    assert field.decode(lattice) == max(every, key=lambda x: x[0])[1]
    alpha, beta = field.forward(lattice, score, False)[0], field.backward(lattice, score)
    total = np.logaddexp.reduce([s for s, _ in every])
    assert np.isclose(pii._sum(alpha[lattice.n], 0), total) and np.isclose(beta[0, 0], total)




def test_labelling_does_not_rest_on_frames():
    rng = random.Random(8)
    field = pii.Field()
    rows = np.random.default_rng(1)
    field.weights, field.follows = rows.normal(size=field.weights.shape), rows.normal(size=field.follows.shape)
    for _ in range(40):
        text = "".join(rng.choice(["1", "22", "@", ".", "-", " ", "a", "é", "\n", ",", "+1 "]) for _ in range(rng.randint(5, 150)))
        for _, tokens in pii.stretches(text):
            whole = field.label(text, tokens)
            assert whole == field.label(text, tokens, frame=1) == field.label(text, tokens, frame=23)
            lattice = pii.Lattice(text, tokens)
            low = min(9, lattice.n)
            part = pii.Lattice(text, tokens, low)
            kept = lattice.end > low
            assert part.spans == [s for s, k in zip(lattice.spans, kept.tolist(), strict=True) if k] and (part.x == lattice.x[kept]).all()
            alpha, _ = field.forward(lattice, lattice.x @ field.weights, True)
            total, at = 0.0, {(i, j): s for (i, j), s in zip(lattice.spans, lattice.x @ field.weights, strict=True)}
            ends, before, j = {b: (a, y) for a, b, y in whole}, 0, lattice.n
            path = []
            while j:
                a, y = ends.get(j, (j - 1, -1))
                path.append((a, j, y))
                j = a
            for a, b, y in reversed(path):
                total, before = total + field.follows[before, y + 1] + (at[a, b][y] if y >= 0 else 0.0), y + 1
            assert np.isclose(total, alpha[-1].max())


def test_a_text_of_numbers_takes_linear_time():
    import time

    rng = random.Random(9)
    field = pii.Field()
    field.weights[2, 1] = 1.0
    took = []
    for n in (4000, 32_000):
        text = " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
        began = time.process_time()
        pii.finder(field)(text)
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0] + 1


def test_media_that_promises_too_much():
    import struct

    from quadrille.llm import media

    deep = b""
    for _ in range(1500):
        deep = struct.pack(">I4s", len(deep) + 8, b"moov") + deep
    assert media._described(deep)["error"] == "boxes nest too deep"
    assert "fragments" in media._described(struct.pack(">I4s", 8, b"moof"))["error"]
    good = media.encode(bytes(range(64)) * 40)
    assert media._described(good)["error"] is None
    at = good.index(b"stsz") + 8
    assert "can't hold" in media._described(good[:at] + struct.pack(">2I", 1, 50_000_000) + good[at + 8 :])["error"]
    runs = good.index(b"stsc") + 12
    huge = good[:runs] + struct.pack(">3I", 1, 0xFFFFFFFF, 1) + good[runs + 12 :]
    assert media._described(huge)["tracks"][0]["n_samples"] == 40
    late = good[: runs + 12] + struct.pack(">3I", 0xFFFFFFFF, 8, 1) + good[runs + 24 :]
    assert media._described(late)["error"] is None or "chunks" in media._described(late)["error"]


def test_digests_of_null_media_and_clashing_names(spark):
    from quadrille.llm import media

    df = spark.createDataFrame([(1, 0, None, "x"), (2, 64, bytearray(media.encode(bytes(64))), "y")], "doc_id long, n_bytes long, media binary, Tracks string")
    got = {r["doc_id"]: r for r in media.stored_digests(df).collect()}
    assert got[1]["payload_sha256"] is None and got[2]["payload_bytes"] == 64
    assert [r["error"] for r in media.track_features(df).orderBy("doc_id").collect()] == ["null", None]
