"""Training-data operators: odd inputs, brute force, exact round trips, bounds."""

import datetime as dt
import math
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.llm import copies, emails, linkage, packing, pii, spans, tokens

AT = dt.datetime(2024, 1, 1)
needs_vocabulary = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


# ---- hidden copies

def found_copies(spark, rows, **options):
    df = spark.createDataFrame(rows, "row_id bigint, primary_key string, cols map<string,string>").withColumn("_a", F.lit("clash")).withColumn("keep_id", F.lit(0))
    return {tuple(r) for r in copies.copies(df, **options).select("keep_id", "dup_id").collect()}


def test_copies_cases(spark):
    rows = [
        (1, "A-1", {"Città": "x y", "b": ""}), (5, " a.1 ", {"B": " ", "città": "X–y"}), (3, "a1", {"città": "x y", "b": ""}), (4, "A 1", {"città": "x y"}),
        (6, None, None), (7, None, {}), (8, "", {}), (9, "-", None), (10, "k", {"a": None}), (11, "k", {"a": ""}), (12, "long", {"t": "w " * 50_000}), (13, "LONG", {"T": "W-" * 50_000}),
    ]
    assert found_copies(spark, rows) == {(1, 5), (6, 7), (8, 9), (12, 13)}
    assert found_copies(spark, []) == set()


def test_copies_hot_group_and_full_filter(spark):
    random.seed(1)
    rows = [(i, "hot" if i % 3 == 0 else random.choice(["K-{}", "k {}", "k.{}"]).format(random.randint(0, 400)), {"a": "b"}) for i in range(1, 1500)]
    form = lambda s: " ".join("".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFC", s.lower())).split())
    first, want = {}, set()
    for i, k, _ in rows:
        if first.setdefault(form(k), i) != i:
            want.add((first[form(k)], i))
    assert found_copies(spark, rows) == want
    assert found_copies(spark, rows, most=1 << 13) == want  # four ranges


def test_filters_keep_singletons_out_at_any_size(spark):
    assert copies.filter_plan(10**9) == (64, 1 << 28) and copies.filter_plan(0) == (1, 1 << 20) and copies.filter_plan(10**12)[0] * (1 << 28) >= 16 * 10**12
    # the load of a billion rows on filters of 2^28 bits, on small ones: 61 million rows a filter's bits times 16
    ranges, bits = copies.filter_plan(40_000, 1 << 17)
    assert ranges == 8 and bits * ranges >= 16 * 40_000
    df = spark.range(40_000).repartition(6).select(F.col("id").alias("row_id"), F.xxhash64("id").alias("_a"), F.xxhash64(F.lit(1), "id").alias("_b"))
    twice = df.filter("row_id < 500").withColumn("row_id", F.col("row_id") + 100_000)
    passed = {r[0] for r in copies.repeats(df.unionAll(twice), ranges, bits).collect()}
    assert passed >= set(range(500)) | set(range(100_000, 100_500)) and len(passed) - 1000 < 0.05 * 39_500


# ---- tokens

@needs_vocabulary
def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    library.encode_special_tokens = True
    random.seed(2)
    alphabet = [chr(c) for c in range(32, 127)] + list("\t\n\r \u0085\u001c àè̀²½Ⅷ　中😀‍﻿") + [" ", "\n", "'", "<|endoftext|>"] * 8
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 50))) for _ in range(1500)] + ["a" * 5000, " " * 300 + "x", "ab" * 3000, "\n" * 90 + " x", "x" * 70 + "=" * 200]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90_001, None), (90_002, "")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r[0]: list(r[1]) for r in tokens.encode(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and got[90_001] == [] and got[90_002] == []
    back = {r[0]: r[1] for r in tokens.decode(tokens.encode(df)).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert tokens.encode(df.limit(0)).count() == 0
    encoder, decoder = tokens.Encoder(tokens.vocabulary_file()), tokens.Decoder(tokens.vocabulary_file())
    for t, w in list(zip(texts, want))[::7]:
        assert np.concatenate(list(encoder.stream([t[i : i + 5] for i in range(0, len(t), 5)]))).tolist() == w if t else True
        assert "".join(decoder.feed([i]) for i in w) + decoder.feed([], last=True) == t


@needs_vocabulary
def test_transducer_keeps_little(spark):
    machine = tokens.Encoder(tokens.vocabulary_file()).machine
    state, kept = 0, 0
    for _ in range(400):
        _, state = machine.feed(b"banana", state)
        kept = max(kept, len(machine.states[state][1]))
    assert kept <= 2 * machine.lookahead


# ---- packing

def best_fit(sizes, capacity):
    """Containers that a literal descending best fit needs."""
    rooms = []
    for n in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_packing(spark):
    random.seed(3)
    sizes = [(i, random.choice([0, 1, 7, 100, 513, 300, 2000, None])) for i in range(800)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").withColumn("capacity", F.lit("clash"))
    rows = packing.pack(df, [("a", 512), ("b", 1000)]).collect()
    for name, cap in (("a", 512), ("b", 1000)):
        own = [r for r in rows if r["pack_name"] == name]
        filled, parts = {}, {}
        for r in own:
            filled[r["container"]] = filled.get(r["container"], 0) + r["n_tokens"]
            parts.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert max(filled.values()) <= cap
        for i, n in sizes:
            want = n or 0
            at = sorted(parts[i])
            assert sum(x for _, x in at) == want and (len(at) == 1 if want <= cap else all(x == cap for _, x in at[:-1]))
        # no packing needs less than its volume; the operator states that it needs no more than descending best fit
        assert math.ceil(sum(filled.values()) / cap) <= len(filled) <= best_fit([r["n_tokens"] for r in own], cap)
    caps = spark.createDataFrame([("a", 512), ("b", 1000)], "pack_name string, capacity_tokens int")
    for r in packing.report(packing.pack(df, [("a", 512), ("b", 1000)]), caps).collect():
        own = [x for x in rows if x["pack_name"] == r["pack_name"]]
        assert r["tokens"] == sum(x["n_tokens"] for x in own) and r["least"] <= r["containers"] == len({x["container"] for x in own}) and 0 <= r["unused"] < 1 and r["cost_spread"] >= 0
    assert packing.pack(df.limit(0), [("a", 5)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [("a", 0)])


def test_balancing_is_even_and_tight():
    sizes = sorted((random.Random(4).randint(1, 512) for _ in range(3000)), reverse=True)
    where = packing.pack_sizes(sizes, 512)
    assert len(set(where)) <= best_fit(sizes, 512)
    assert packing.balance([5, 5, 1, 1], 6) == [0, 1, 0, 1] and packing.pack_sizes([], 5) == []


# ---- spans

def brute(texts, length):
    own, multi = {}, set()
    for d, t in texts:
        for i in range(len(t or "") - length + 1):
            w = t[i : i + length]
            if own.setdefault(w, d) != d:
                multi.add(w)
    out = set()
    for d, t in texts:
        cover = [False] * len(t or "")
        for i in range(len(cover) - length + 1):
            if t[i : i + length] in multi:
                cover[i : i + length] = [True] * length
        start = None
        for i, c in enumerate([*cover, False]):
            if c and start is None:
                start = i
            elif not c and start is not None:
                out.add((d, start, i))
                start = None
    return out


@pytest.mark.parametrize("hot,known,block", [(50_000, 4_000_000, 1 << 21), (2, 4_000_000, 400), (50_000, 3, 400)])
def test_shared_spans_like_brute_force(spark, monkeypatch, hot, known, block):
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "KNOWN", known)
    monkeypatch.setattr(spans, "BLOCK", block)
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdeé😀 ", k=rnd.randint(1, 12))) for _ in range(60)]
    share = ["".join(rnd.choices(words, k=rnd.randint(3, 14))) for _ in range(6)]
    texts = [(i, "".join(rnd.choice(share) if rnd.random() < 0.4 else "".join(rnd.choices("abcdeé😀 xyz", k=rnd.randint(1, 40))) for _ in range(rnd.randint(1, 6)))) for i in range(60)]
    texts += [(100, "ab" * 80), (101, "ab" * 70), (102, "z" * 90), (103, None), (104, ""), (105, share[0] * 3 + share[0]), (106, texts[0][1]), (107, "q" * 200)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("_id", F.lit("clash")).repartition(3)
    got = {tuple(r) for r in spans.shared_spans(df, length=30, k=12).collect()}
    assert got == brute(texts, 30)
    assert spans.shared_spans(df.limit(0), length=30, k=12).count() == 0


def test_chains_find_reworded_copies(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choices("abcdefghij ", k=900))
    other = "x" * 50 + text[:300] + "REWORDED" + text[320:700] + "MORE" + text[700:]
    df = spark.createDataFrame([(1, text), (2, other), (3, "".join(rnd.choices("klmnop", k=900))), (4, None)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["other"]): r for r in spans.passages(df).collect()}
    assert set(got) == {(1, 2), (2, 1)}
    assert (got[1, 2]["start_pos"], got[1, 2]["end_pos"]) == (0, 900) and got[1, 2]["similarity"] > 0.95
    best = spans.chains([(0, 0), (100, 100), (200, 30), (210, 200), (300, 310)], 64)[0]
    assert best == [(0, 0), (100, 100), (210, 200), (300, 310)]


@pytest.mark.parametrize("known", [4_000_000, 3])
def test_passages_of_every_pair_and_place(spark, monkeypatch, known):
    monkeypatch.setattr(spans, "SALT", 2)
    monkeypatch.setattr(spans, "KNOWN", known)
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choices("abcdefghij ", k=n))
    a, b, c, twice = text(100), text(100), text(100), text(200)
    rows = [(1, a + text(90)), (2, b + text(90)), (5, text(50) + a + "+" + b + "+" + c), (6, a + "-" + b + "-" + c + text(70)), (9, a + text(80)), (10, b + text(80))]
    rows += [(20, twice), (21, twice + text(60) + twice), (30, text(400)), (None, text(400))]
    rows += [(31, rows[-2][1]), (32, rows[-2][1]), (40, rows[-1][1])]
    # two passages far apart are two, not one that is too unlike
    p, q = text(400), text(400)
    rows += [(50, p + text(900) + q), (51, p + text(900) + q)]
    got = spans.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    pairs = {(r["doc_id"], r["other"]) for r in got}
    want = {(5, 6), (20, 21), (30, 31), (30, 32), (31, 32), (None, 40), (50, 51)}
    assert pairs == want | {(y, x) for x, y in want}
    at = {(r["doc_id"], r["other"], r["start_pos"], r["other_start"]) for r in got}
    assert {(20, 21, 0, 0), (20, 21, 0, 260), (21, 20, 260, 0), (50, 51, 0, 0), (50, 51, 1300, 1300)} <= at
    # brute force: the two texts with all their common runs as anchors
    for x, y in (rows[2:4], rows[6:8]):
        anchors = [(i, j) for i in range(len(x[1]) - 63) for j in range(len(y[1]) - 63) if x[1][i : i + 64] == y[1][j : j + 64]]
        assert {f[:4] for f in spans.matches(x[1], y[1], anchors, 150, 64, 0.8)} == {(r["start_pos"], r["end_pos"], r["other_start"], r["other_end"]) for r in got if (r["doc_id"], r["other"]) == (x[0], y[0])}


# ---- emails

MAIL = "msg_id string, subject string, sender string, recipient string, body string, snippet string, sent_date string, internal_ts timestamp"


def new_text(spark, rows):
    df = spark.createDataFrame(rows, MAIL).withColumn("line_no", F.lit("clash")).withColumn("thread", F.lit("clash"))
    out = {}
    for r in emails.new_text(df).collect():
        out.setdefault(r["msg_id"], set()).add(r["line_no"])
    return out


def test_new_lines(spark):
    first = "Ciao Luca,\n\nIl cavo AB123456 va sulla fase 2.\nDa: KM667156.9\nTo: QE-381932\nIl 2 marzo il cliente ha scritto: serve XX999888 subito\n\nGrazie\nAnna\n-- \nAnna Rossi | Acme\n****\nMessaggio trattato secondo la nostra informativa privacy."
    anna, luca = '"Rossi Anna" <anna.rossi@acme.test>', "Luca Verdi <l.verdi@beta.test>"
    rows = [
        ("a", "Ordine 1", anna, luca, first, None, "2024-01-01T10:00:00Z", AT + dt.timedelta(days=9)),
        ("a", "Ordine 1", anna, luca, first, None, None, AT + dt.timedelta(days=9)),
        ("b", "Re: R: Ordine 1", luca, anna, "Va bene TT111222.\r\n\r\nIl 01/01/2024 10:00, Anna Rossi\r\n<anna.rossi@acme.test> ha scritto:\r\n> Ciao Luca,\r\n> Il cavo AB123456 va sulla fase 2.\r\nRisposta in mezzo YY121212.\r\n", None, "2024-01-02T10:00:00Z", AT),
        ("c", "re: ordine 1", luca, None, "Visto ZZ343434.\n\n***\nCiao Luca,\nIl cavo AB123456 va sulla\nfase 2.", None, None, AT + dt.timedelta(days=12)),
        ("d", None, None, None, '<html><body>\n<p>Hi</p>\n<br>\n<div>Sheet AB777777 moved.</div>\n<blockquote type="cite">\n<p>old</p>\n</blockquote>\n</body></html>', None, None, None),
        ("e", "x", luca, anna, None, None, None, AT), ("f", "x", luca, anna, "", None, None, AT), ("g", "I: y", luca, anna, "Ecco.\n\n---------- Messaggio inoltrato ----------\nDa: Anna Rossi <a@b.test>\nInviato: lun 1 gennaio 2024 10:00\nA: Luca\n\nTesto", None, None, AT),
        ("h", "z", luca, anna, "riga HH123123\n" * 5000, None, None, AT),
    ]
    got = new_text(spark, rows)
    assert got["a"] == {1, 3, 4, 5, 6, 8}
    assert got["b"] == {1, 7}
    assert got["c"] == {1}
    assert got["d"] == {2, 4}
    assert got["g"] == {1} and "e" not in got and "f" not in got and len(got["h"]) == 5000
    assert new_text(spark, []) == {}


def thread_of_copies():
    anna, luca = '"Rossi Anna" <anna.rossi@acme.test>', "l.verdi@beta.test"
    old = "il quadro della cabina sud va spostato accanto al muro del magazzino\ne i cavi grigi restano dove sono finché non arriva la ditta"
    said = ["Il tubo lungo non entra nel cassone piccolo", "Domani passa il muratore per vedere la porta", "Nessuno ha la chiave del cancello verde", "La scala di legno è ancora rotta"]
    foot = "\n\nSaluti\nLuca Verdi\nufficio collaudi e prove\nmessaggio letto dalla nostra segretaria"
    rows = [("m0", "Cabina", anna, luca, old, None, None, AT)]
    rows += [(f"m{i + 1}", "Re: Cabina", luca, anna, text + "\n\n" + old.replace("muro del", "muro\ndel") + foot, None, None, AT + dt.timedelta(days=i + 1)) for i, text in enumerate(said)]
    # the same person without closing words: only the dictionary of closings shows the end
    rows += [("n0", "Altro", luca, anna, "Il tetto perde acqua\nLuca Verdi\nufficio collaudi e prove\nmessaggio letto dalla nostra segretaria", None, None, AT)]
    # another thread may say the same; it is no copy there
    return rows + [("o", "Vicino", luca, anna, old, None, None, AT + dt.timedelta(days=9))]


def test_copies_without_numbers_and_learned_closings(spark):
    got = new_text(spark, thread_of_copies())
    # closing words below a copy count as its own
    assert got == {"m0": {1, 2}, "n0": {1}, "o": {1, 2}} | {f"m{i}": {1} for i in range(1, 5)}


def test_compression_decides(spark, monkeypatch):
    rows = thread_of_copies()
    # without dictionaries the pasted text and the closings are taken for new
    class Nothing(emails.Dictionary):
        def __init__(self, parts):
            super().__init__([])

    copied = sum(len(b[4].split("\n")) for b in rows)
    lines = lambda limit, kind: sum(len(emails.new_lines(*emails.parsed(r[4]), r[2], kind([rows[0][4]] if r[0][0] == "m" and r[0] != "m0" else []), kind([]), emails.gains(emails.parsed(r[4])[0], emails.asking(*emails.parsed(r[4])), kind([rows[0][4]])), limit)) for r in rows)
    own = lines(0.6, emails.Dictionary)
    assert own < lines(0.6, Nothing) == lines(9, emails.Dictionary) <= copied
    assert lines(0.6, Nothing) - own >= 0.1 * copied


def test_gains_part_where_their_classes_do():
    assert 0.4 < emails.threshold({}) < 0.8
    assert 0.3 < emails.threshold({10: 900, 12: 500, 20: 30, 46: 300, 48: 500}) < 0.9
    rnd = random.Random(11)
    text = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(9000))
    assert emails.gain(text, [text[:40_000], text[40_000:]]) > 0.5 and emails.gain("", ["x"]) == 0 and emails.gain("abc", []) == 0


def test_personal_data(spark):
    body = "Ciao Marta,\nscrivi a m.rossi+x@acme.test o (0841) 462 6968.\nIl badge va intestato a Polrossi Irene, C.F. ZPB MFB 58B06 G228M, residente in via Colle Verdino n. 12 - 20100 Pian di Selce (XA).\nIl cavo rosa va qui, misura 330.120.4500 mm, protocollo 2024/599544-25. La fattura va a stefano bianchi, Lindenweg 65."
    rows = [("a", None, "Marta Verdi <mv@acme.test>", None, body, "Ciao Marta, scrivi a m.rossi+x@acme.test", None, AT), ("a", None, "Marta Verdi <mv@acme.test>", None, body, "Ciao Marta, scrivi a m.rossi+x@acme.test", None, AT), ("b", None, None, None, None, None, None, None), ("c", None, None, None, "", "", None, AT)]
    df = spark.createDataFrame(rows, MAIL).withColumn("word", F.lit("clash")).withColumn("revealing", F.lit(1))
    got = {tuple(r)[1:] for r in pii.find(df).collect()}
    assert {x for x in got if x[0] == "body"} == {
        ("body", "NAME", "Marta"), ("body", "EMAIL", "m.rossi+x@acme.test"), ("body", "PHONE", "(0841) 462 6968"), ("body", "NAME", "Polrossi Irene"), ("body", "ID_NUMBER", "ZPB MFB 58B06 G228M"),
        ("body", "ADDRESS", "via Colle Verdino n. 12 - 20100 Pian di Selce (XA)"), ("body", "NAME", "stefano bianchi"), ("body", "ADDRESS", "Lindenweg 65"),
    }
    clean = {r["msg_id"]: r for r in pii.sanitise(df).collect()}
    assert clean["a"]["snippet"] == "Ciao [NAME], scrivi a [EMAIL]" and clean["b"]["body"] is None and clean["c"]["body"] == ""
    assert "Rossi" not in clean["a"]["body"] and "misura 330.120.4500 mm" in clean["a"]["body"]
    assert pii.find(df.limit(0)).count() == 0


def test_disclosure_is_learned_and_decides(spark, monkeypatch):
    people = ["Anna Rossi", "Luca Verdi", "Marta Bianchi", "Piero Neri"]
    rows = []
    for i in range(40):
        who = people[i % 4]
        rows.append((f"m{i}", None, f"{who} <{i % 4}@acme.test>", None, f"Ieri ho incontrato {who.split()[0]} al bar. La Marca resta uguale. Domani torna la Marca. Il Quadro è pronto.", None, None, AT))
    rows.append(("x", None, None, None, "Ieri ho incontrato Zork al bar.", "Il Quadro è di Zork", None, AT))
    df = spark.createDataFrame(rows, MAIL)
    found = lambda: {r["pii_text"] for r in pii.find(df).collect() if r["pii_type"] == "NAME"}
    assert found() == {"Anna", "Luca", "Marta", "Piero", "Zork"}
    monkeypatch.setattr(pii, "BITS", -99.0)
    assert found() > {"Anna", "Luca", "Marta", "Piero", "Zork"}
    monkeypatch.setattr(pii, "BITS", 99.0)
    assert found() == set()


def test_telling_terms_are_generalised(spark):
    rows = []
    for i in range(64):
        firm = "Zetafirma" if i % 16 == 0 else "Comune"
        rows.append((f"m{i}", None, f"{'Anna' if i % 16 == 0 else 'Luca'} Rossi <p{i % 16}@acme.test>", None, f"Il cavo va bene, dice la ditta {firm} oggi.", None, None, AT))
    df = spark.createDataFrame(rows, MAIL)
    clean = {r["msg_id"]: r["body"] for r in pii.sanitise(df).collect()}
    assert clean["m16"] == "Il cavo va bene, dice la ditta [TERM] oggi." and clean["m1"] == rows[1][4]
    assert "TERM" not in {r["pii_type"] for r in pii.find(df).collect()}


def test_flat_places():
    raw = "<p>A&amp;B</p>\r\n<p>&gt; c  d</p>"
    flat = pii.Flat(raw)
    at = flat.text.index("d")
    assert raw[slice(*flat.slice(at, at + 1))] == "d" and raw[slice(*flat.slice(flat.text.index("&"), flat.text.index("B") + 1))] == "&amp;B"
    rnd = random.Random(12)
    for _ in range(200):
        raw = "".join(rnd.choices(["a", "Bc", " ", "\n", "\r\n", "> ", "|", "\t", "é", "\u00a0"], k=30))
        flat = pii.Flat(raw)
        for i, c in enumerate(flat.text):
            x, y = flat.slice(i, i + 1)
            assert x < y and (raw[x:y] == c or c.isspace())


# ---- linkage

def test_linkage(spark):
    rnd = random.Random(7)
    kinds, things, where = ["Computo", "Pianta", "Sezione", "Calcolo"], ["drenaggio", "rete dati", "fondazioni", "serramenti"], ["lotto 1", "blocco C", "piano terra"]
    left, right, truth = [], [], set()
    for i in range(300):
        code, text, day = f"GFZ-{rnd.choice(['STR', 'MEC'])}-{i + 1:04d}", f"{rnd.choice(kinds)} {rnd.choice(things)} - {rnd.choice(where)} - asse {rnd.randint(1, 60)}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
        pages = rnd.choice([1, 2, 4, rnd.randint(5, 90)])
        if rnd.random() < 0.8:
            left.append((f"E{i}", rnd.choice([code, code.lower().replace("-", "."), None]), text.upper() if i % 2 else text, "STR", day.strftime("%d/%m/%Y"), None, pages))
        if rnd.random() < 0.8:
            right.append((f"F{i}", rnd.choice([code.replace("-", " "), code.replace("-0", "-O")]), text.replace("blocco", "bl."), None, day, "x srl", pages))
        if left and right and left[-1][0] == f"E{i}" and right[-1][0] == f"F{i}":
            truth.add((f"E{i}", f"F{i}"))
    left += [("E900", None, None, None, None, None, None), left[0]]
    a = spark.createDataFrame(left, "entry_id string, table_code string, table_description string, discipline string, issue_date string, author string, pages int").withColumn("id", F.lit(0)).withColumn("keys", F.lit(0))
    b = spark.createDataFrame(right, "document_id string, folder_code string, folder_description string, discipline string, revised_at timestamp, author string, pages int")
    got = {(r[0], r[1]) for r in linkage.link_documents(a, b).filter("confidence >= 0.5").collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.05 * len(truth)
    assert linkage.link_documents(a.limit(0), b).count() == 0


def test_candidates_of_cut_descriptions_and_slips(spark):
    day = dt.datetime(2024, 3, 1)
    left = [("no code", None, "Schema unifilare quadro", "ELE", "01/03/2024", "x srl", 4), ("no date", None, "Schema unifilare quadro", "ELE", None, "x srl", 4),
            ("swapped", "GFZ-ELE-0505", "Schema unifilare quadro", "ELE", None, None, None), ("lost", "GFZ-ELE-055", "Pianta di tutto", "ELE", None, None, None), ("project", "FGZX-ELE-055", None, "ELE", None, None, None), ("within", "GFZ-ELE-5", "Schema", "ELE", None, None, None)]
    text = "Schema unifilare quadro rete dati - lotto 1 - asse 7"
    right = [("F1", "GFZ-ELE-0055", text, None, day, "x srl", 4), ("F2", None, text, None, day + dt.timedelta(days=21), None, None), ("F3", "GFZ-ELE-0555", text, None, None, None, None)]
    a = spark.createDataFrame(left, "entry_id string, table_code string, table_description string, discipline string, issue_date string, author string, pages int")
    b = spark.createDataFrame(right, "document_id string, folder_code string, folder_description string, discipline string, revised_at timestamp, author string, pages int")
    got = {(r["id"], r["id_b"]) for r in linkage.candidates(linkage.formed(a, linkage.ENTRY), linkage.formed(b, linkage.FOLDER, True)).collect()}
    assert got >= {("no code", "F1"), ("no code", "F2"), ("no date", "F1"), ("swapped", "F1"), ("lost", "F1"), ("lost", "F3"), ("project", "F1"), ("within", "F1"), ("within", "F3")}


def test_candidates_of_common_keys_grow_with_the_rows(spark):
    day, n = dt.datetime(2024, 3, 1), 60
    # one description and date for all: only author and pages together tell partners apart; equal rows all meet
    left = [(f"E{i}", None, "Schema unifilare quadro", "ELE", "01/03/2024", f"{'abcdefghij'[i % 10]} srl", 5 + i // 10) for i in range(n)]
    right = [(f"F{i}", None, "Schema unifilare quadro elettrico", None, day, f"{'abcdefghij'[i % 10]} srl", 5 + i // 10) for i in range(n)]
    same = "Pianta fondazioni lotto 1 asse 7"
    left += [(f"C{i}", None, same, "ELE", "01/06/2023", "x srl", 4) for i in range(15)]
    right += [(f"D{i}", None, same, None, dt.datetime(2023, 6, 1), "x srl", 4) for i in range(15)]
    a = spark.createDataFrame(left, "entry_id string, table_code string, table_description string, discipline string, issue_date string, author string, pages int")
    b = spark.createDataFrame(right, "document_id string, folder_code string, folder_description string, discipline string, revised_at timestamp, author string, pages int")
    got = {(r["id"], r["id_b"]) for r in linkage.candidates(linkage.formed(a, linkage.ENTRY), linkage.formed(b, linkage.FOLDER, True)).collect()}
    assert got >= {(f"E{i}", f"F{i}") for i in range(n)} | {(f"C{i}", f"D{j}") for i in range(15) for j in range(15)}
    assert len(got) <= 4 * n + 15 * 15


def test_plan_of_candidates_does_not_grow_with_the_rounds(spark):
    # two rows meet at once, forty need rounds of narrowing
    left = [(f"E{i}", None, "Schema unifilare quadro", "ELE", "01/03/2024", f"{'abcdefghij'[i % 10]} srl", 5 + i // 10) for i in range(40)]
    right = [(f"F{i}", None, "Schema unifilare quadro elettrico", None, dt.datetime(2024, 3, 1), f"{'abcdefghij'[i % 10]} srl", 5 + i // 10) for i in range(40)]
    a = spark.createDataFrame(left, "entry_id string, table_code string, table_description string, discipline string, issue_date string, author string, pages int")
    b = spark.createDataFrame(right, "document_id string, folder_code string, folder_description string, discipline string, revised_at timestamp, author string, pages int")
    joins = [linkage.candidates(linkage.formed(a.limit(n), linkage.ENTRY), linkage.formed(b.limit(n), linkage.FOLDER, True))._jdf.queryExecution().optimizedPlan().toString().count("Join ") for n in (2, 40)]
    assert joins == [2, 2]  # each pair meets its two rows


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(8)
    y = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.85, 0.7, 0.7])
    votes = np.where(rng.random((len(y), 4)) < right, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    votes = np.hstack([votes, votes[:, 3:]])  # a function that only repeats another one
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = linkage.LabelModel(patterns, counts)
    assert abs(model.prior - 0.3) < 0.05 and (model.post[at.ravel()] > 0.5).astype(bool).__eq__(y).mean() > 0.94
    assert model.weights[4] < 0.9 and model.weights[3] < 0.9


def test_codes_and_descriptions():
    assert linkage.coded("RYO.ELE.O144.A")[2] == "144" and linkage.coded("GFZSTR08360")[2] == "836" and linkage.coded(None) == ("", "", "")
    assert linkage.described("BOM imp. elettrico – bl. C – campata 45") == linkage.described("campata 45, DISTINTA MATERIALI IMPIANTO ELETTRICO blocco c")
