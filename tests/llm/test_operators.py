"""Each operator on small hand-made tables, against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from lexiloom.llm import decontaminate, html_text, language, line_templates, minhash, neighbours, packing, pii, repeats, token_files
from lexiloom.llm.tokens import word_ids
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [(None, "no id, just text that is long enough to be looked at by anyone"), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (8, "one"), (9, "word " * 3000)]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def sentences(seed, n_words, stock=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(stock)}" for _ in range(n_words))


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if good[k](m[0])]
    return ",".join(s for _, _, s in sorted(found))


PRIVATE = [
    "a@b.c_d@e.f foo@bar@baz.com x@y ..@a.b-c.de é@ü.x mail: joe.x+1%@ex-ample.co.uk.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.000.1.01 1.2.3 999.1.1.1.1.1.1",
    "𝄞𝄞 card 4111 1111 1111 1111; 4111-1111-1111-1112, 41111111111111111111 or 5500005555555559: 1 2 3",
    "+49 (30) 1234-5678 +1 2 +1 555 123 4567 8901 2345 ++44.20.7946.0958 +1 (743) 555-3824,",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and DE89370400440532013001",
    "my social security number is 123-45-6789 but 123-45-6789 alone far away from it all, ssn 000-12-3456",
    "1" * 40000 + " " + "a" * 40000 + "@" + " 1.1" * 20000,
    "4111 1111 1111 1111 a@b.cd " * 50,
]


def test_pii_equals_plain_patterns(documents):
    data = ODD + [(100 + i, t) for i, t in enumerate(PRIVATE)]
    got = pii.pii_digest(documents(data)).collect()
    want = Counter((i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in data)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    spans = {r.doc_id: r for r in got}
    assert spans[104].n_iban == 2 and spans[105].n_ssn == 1
    assert spans[102].n_card == 2 and spans[5].spans == "" and spans[5].n_email == 0
    assert spans[105].scores == "65"
    assert rows_of(pii.pii_digest(documents([]))) == []


def test_places_of_many_spans(spark, documents):
    text = "; ".join(f"a{i}@b{i % 7}.org, é 10.0.{i % 300}.1" for i in range(5000))
    row = pii.find_pii(documents([(1, text)])).collect()[0]
    assert [text[x.start : x.end] for x in row.found] == [x.text for x in row.found]
    assert Counter(x.rank for x in row.found) == {0: 5000, 1: sum(i % 300 <= 255 for i in range(5000))}
    numbers = spark.createDataFrame([(n, list(range(n))) for n in (0, 1, 2, 3, 7, 8, 9, 64, 100)], "n INT, x ARRAY<BIGINT>")
    for r in numbers.select("n", pii._running(numbers.x).alias("sums")).collect():
        assert r.sums == [k * (k + 1) // 2 for k in range(r.n)]


def test_pii_context_raises_the_score(documents):
    got = {r.doc_id: r.scores for r in pii.pii_digest(documents([(1, "call me: +1 555 123 4567"), (2, "see it: +1 555 123 4567")])).collect()}
    assert got == {1: "80", 2: "60"}


# near-duplicates


def shingle_set(text, size):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def components_of(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(documents, size):
    draw, data = random.Random(3), list(ODD)
    for group in range(12):
        words = sentences(group, 60).split()
        for copy in range(draw.randrange(1, 9)):
            own = list(words)
            for _ in range(draw.randrange(0, 6)):
                own[draw.randrange(len(own))] = f"new{draw.randrange(10**6)}"
            data.append((1000 - len(data), " ".join(own).upper() if copy % 2 else " ".join(own)))
    got = minhash.near_duplicates(documents(data), words=size).collect()
    sets = [(i, shingle_set(t, size)) for i, t in data]
    known = [(i, s) for i, s in sets if i is not None and s]
    links = [(a, b) for x, (a, s) in enumerate(known) for b, t in known[:x] if 100 * len(s & t) >= 80 * len(s | t)]
    want = components_of({i for i, _ in data if i is not None}, links)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(s), want.get(i)) for i, s in sets)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(documents([]), words=size).count() == 0


def test_a_chain_of_links_is_one_component(documents):
    words = [f"c{i}" for i in range(200)]
    data = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(30)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(data), words=2).collect()}
    assert set(got.values()) == {0}


def test_sequential_test_keeps_what_the_posterior_allows():
    limits = minhash.least_agreements(80)
    assert len(limits) == minhash.BATCHES and limits == sorted(limits)
    for n, least in zip(range(minhash.BATCH, 99, minhash.BATCH), limits):
        tail = lambda m: sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert tail(least) >= minhash.MISS and (least == 0 or tail(least - 1) < minhash.MISS)


# packing and token files


def plain_ids(data):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")) for i, t in data]


def test_word_ids_equal_the_library():
    ids = word_ids(VOCABULARY)
    assert ids.by_word and not word_ids(public_tokenizers.path("byte_bpe_50k.json")).by_word
    for text in ["ΑΣ Σ. İx, é ǅ Ǆabc. ﬁne, ﬀ.", "'s don't I'LL. x.y,z", "a\x1cb", "<|endoftext|>. A<|endoftext|>b,", "日本語。한국어 각, ", "가 x", "a" * 500, ""]:
        assert ids.text(text) == plain_ids([(0, text)])[0][1].tobytes()


def test_packing_holds_every_id_once(documents):
    data = ODD + [(20 + i, sentences(i, n)) for i, n in enumerate([1, 10, 700, 1300, 2500, 9000])]
    packed = packing.packed_pieces(documents(data), VOCABULARY, sequence_tokens=1024)
    pieces = packed.collect()
    whole = defaultdict(list)
    for i, ids in plain_ids(data):
        whole[i].append(ids.tobytes())
    runs = defaultdict(dict)
    for r in pieces:
        runs[r.doc_id, r.start][r.piece_id] = r
        assert any(bytes(r.ids) == ids[4 * r.start : 4 * (r.start + r.length)] and len(ids) == 4 * r.doc_tokens for ids in whole[r.doc_id])
    assert sum(r.length for r in pieces) == sum(len(ids) // 4 for own in whole.values() for ids in own)
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in pieces)
    assert len(by_sequence) <= math.ceil(total / 1024) + 1
    full = packing.padded_sequences(packed, 1024).collect()
    assert {r.sequence_id: r.n_tokens for r in full} == {k: sum(n for _, n in v) for k, v in by_sequence.items()}
    assert all(len(r.ids) == 1024 or len(r.ids) == r.n_tokens for r in full)
    assert packing.packed_pieces(documents([]), VOCABULARY).count() == 0


def test_first_fit_decreasing_equals_a_plain_scan():
    draw = random.Random(1)
    for _ in range(40):
        lengths = [draw.choice([draw.randrange(1, 101), 50, 100]) for _ in range(draw.randrange(0, 60))]
        rooms, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            k = next((k for k, room in enumerate(rooms) if room >= lengths[i]), len(rooms))
            if k == len(rooms):
                rooms.append(100)
            want[i] = (k, 100 - rooms[k])
            rooms[k] -= lengths[i]
        got = packing.first_fit_decreasing(lengths, 100)
        assert [want[i] for i in range(len(lengths))] == list(zip(*got, strict=True))


def test_token_files_give_back_all_ids(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 4096)
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    data = ODD + [(30 - i, sentences(i, n)) for i, n in enumerate([1, 10, 700, 9000, 2500])]
    files = token_files.write_token_files(documents(data), f"file://{tmp_path}", VOCABULARY)
    got = token_files.read_token_files(files).orderBy("start").collect()
    ids = sorted(plain_ids(data), key=lambda x: (x[0] is not None, x[0]))
    starts = np.cumsum([0] + [len(x) for _, x in ids]).tolist()
    assert [r.doc_id for r in got] == [i for i, _ in ids]
    assert [r.start for r in got] == starts[:-1]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    assert {r.doc_id for r in token_files.read_token_files(files, [27, 9]).collect()} == {27, 9}


def test_token_file_is_plain_zstandard_and_detects_damage(documents, tmp_path):
    import io

    import zstandard

    file = token_files.write_token_files(documents([(1, sentences(1, 50)), (2, "two")], 1), f"file://{tmp_path}", VOCABULARY).first().file
    data = open(file.removeprefix("file://"), "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.startswith(b"".join(x.tobytes() for _, x in plain_ids([(1, sentences(1, 50)), (2, "two")])))

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    whole = token_files.TokenFile(Source(data))
    assert [d for d, _, _ in whole.spans()] == [1, 2]
    damaged = bytearray(data)
    damaged[-9 - 12 * len(whole.frames) + 8] ^= 1  # the first frame's checksum
    with pytest.raises(ValueError, match="damaged"):
        b"".join(token_files.TokenFile(Source(bytes(damaged))).chunks(0, 3))


def test_token_files_of_an_empty_table(documents, tmp_path):
    assert rows_of(token_files.read_token_files(token_files.write_token_files(documents([]), f"file://{tmp_path}", VOCABULARY))) == []


# languages

STOCK = {"en": "the of and thing with that have this", "fr": "les des une dans être avec pour très", "de": "der die und nicht über schön eine mit"}


def language_rows(n):
    draw = random.Random(5)
    return [(i, " ".join(draw.choice(STOCK[x].split()) for _ in range(draw.randrange(3, 60))), x) for i, x in enumerate(draw.choice(list(STOCK)) for _ in range(n))]


def test_languages_on_held_out_rows(documents):
    data = language_rows(300) + [(i, t, None) for i, t in ODD] + [(900, "12 34 !?", "fr"), (901, "x" * 10, None)]
    got = {(r.doc_id, r.held_out): r for r in language.identify_languages(documents(data)).collect()}
    truth = {i: x for i, _, x in data if i is not None and i < 300}
    held = [r for (i, h), r in got.items() if h and i in truth]
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got)
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    by_id = {i: r for (i, _), r in got.items()}
    assert [by_id[i].lang_pred for i in (5, 6, 7, 900)][1:] == ["und"] * 3 if 5 not in truth else by_id[900].lang_pred == "und"
    assert language.identify_languages(documents([])).count() == 0


def test_nothing_learnt_means_unknown(documents):
    assert {r.lang_pred for r in language.identify_languages(documents([(1, "some text"), (2, None)])).collect()} == {"und"}


def test_signs_are_no_letters(documents):
    signs = [(1000 + i, t, None) for i, t in enumerate(["½ ² ① Ⅷ", "12_3 !?", "½ a", "жи"])]
    got = {r.doc_id: r.lang_pred for r in language.identify_languages(documents(language_rows(60) + signs)).collect()}
    assert [got[i] == "und" for i in range(1000, 1004)] == [True, True, False, False]


def test_same_predictions_whatever_the_partitions(documents, monkeypatch):
    docs = documents(language_rows(200))
    few = docs.select("lang", "text")
    learnt = [language.train(few.repartition(n, "text"), per_language=20) for n in (3, 30)]
    assert learnt[0].languages == learnt[1].languages and abs(learnt[0].weights - learnt[1].weights).max() < 1e-5
    copied = language.train(few.union(few).union(few), per_language=20)
    assert abs(learnt[0].weights - copied.weights).max() < 1e-5


def test_margins_are_those_of_kernel_ridge_regression():
    """With every text a landmark, the folded weights give the ridge solution on the kernel itself."""
    import numpy as np

    rows = sorted((x, t) for _, t, x in language_rows(40))
    found = language.presence([t for _, t in rows])
    packed = np.packbits(found.astype(bool), axis=1)
    model = language.fit([(x, p.tobytes()) for (x, _), p in zip(rows, packed, strict=True)], landmarks=1000, ridge=1e-2)
    unit = (found / np.sqrt(found.sum(axis=1, keepdims=True))).astype(np.float64)
    kernel = unit @ unit.T
    target = np.array([[1.0 if x == name else -1.0 for name in model.languages] for x, _ in rows])
    own = Counter(x for x, _ in rows)
    weight = np.array([len(rows) / own[x] / len(model.languages) for x, _ in rows])
    solved = np.linalg.solve(np.diag(weight) @ kernel + 1e-2 * len(rows) * np.eye(len(rows)), weight[:, None] * target)
    assert np.abs(unit @ model.weights - kernel @ solved).max() < 1e-3


def test_long_texts_are_gone_through_in_parts(monkeypatch):
    text = sentences(4, 3000)
    whole = language.presence([text, "b", text[:50]])
    monkeypatch.setattr(language, "BATCH_CHARS", 1000)
    again = language.presence([text, "b", text[:50]])
    missing = (whole > again).sum()
    assert missing == 0 and (again > whole).sum() <= 4 * 3 * (len(text) // 1000 + 1)


# repeated passages


def removed_by_brute_force(data, span=50):
    first = {}
    for i, t in data:
        text = (t or "").encode()
        if i is not None:
            for at in range(len(text) - span + 1):
                key = text[at : at + span]
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in data:
        text = (t or "").encode()
        gone = bytearray(len(text))
        for at in range(len(text) - span + 1) if i is not None else ():
            if first[text[at : at + span]] < i:
                gone[at : at + span] = b"\1" * span
        runs = len([1 for a, b in zip(b"\0" + gone, gone, strict=False) if b > a])
        out.append((i, len(text), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(text, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats_equal_brute_force(documents, monkeypatch):
    draw = random.Random(9)
    passages = [sentences(100 + i, n, 50) for i, n in enumerate([6, 8, 9, 10, 12, 20, 80])] + ["é" * 60, "ab" * 70, "-" * 49, "=" * 50, "x" * 300]
    data = list(ODD)
    for i in range(60):
        data.append((draw.randrange(20, 60), " ".join(draw.choice([sentences(i * 10 + k, draw.randrange(1, 9), 10**6), draw.choice(passages)]) for k in range(draw.randrange(1, 9)))))
    data += [(61, data[-1][1]), (62, data[-1][1]), (62, data[-2][1])]
    monkeypatch.setattr(repeats, "PART_BYTES", 3000)
    got = rows_of(repeats.removal_digest(documents(data)))
    assert Counter(got) == Counter(removed_by_brute_force(data))
    assert repeats.removal_digest(documents([])).count() == 0


def test_triggers_do_not_depend_on_blocks(monkeypatch):
    text = sentences(8, 4000).encode()
    part = repeats.Part([1, 2], [text[:9000], text[9000:]])
    whole, hashes = (x.tolist() for x in part.triggers())
    assert part.around(np.array(whole), 0, repeats.TRIGGER).tolist() == hashes
    monkeypatch.setattr(repeats, "BLOCK", 700)
    assert part.triggers()[0].tolist() == whole
    starts = np.arange(9000 - repeats.SPAN + 1)
    places = np.searchsorted(whole, starts)
    assert all(whole[p] <= s + repeats.REACH for p, s in zip(places, starts, strict=True))


# lines


def test_lines_with_changing_fields_are_dropped(documents):
    data = [(10 + i, f"own text number {sentences(i, 8)} here\nPage {i} of {i + 7} was last changed by user{i}\nShort line") for i in range(20)]
    data += [(300 + i, f"{i} 17 {i * i} 12.5 {i}%") for i in range(15)]  # numbers alone are no template
    data += [(i, t) for i, t in ODD] + [(200, "Page 3 of 9 was last changed by user4 \nA line of five words"), (201, "a\n\nPage 1 of 1 was last changed by user1")]
    got = line_templates.drop_recurring_lines(documents(data)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(data) and got[0].rep == "x"
    assert by_id[10].n_dropped == 0  # the smallest id keeps it
    assert all(by_id[10 + i].n_dropped == 1 and "changed by" not in by_id[10 + i].text and "Short line" in by_id[10 + i].text for i in range(1, 20))
    assert all(by_id[300 + i].n_dropped == 0 for i in range(15))
    assert by_id[201].text == "a\n" and by_id[201].n_lines == 3
    assert by_id[200].n_dropped == 0  # one more, empty, word
    assert by_id[5].text is None and by_id[5].n_lines == 0 and by_id[6].text == ""
    assert line_templates.drop_recurring_lines(documents([])).count() == 0


def test_names_become_fields_too_and_copies_count_once(documents):
    people = ["Ann", "Bo", "Cy", "Di", "Ed", "Flo", "Gus", "Hal", "Ida", "Jo", "Kim", "Lou"]
    lines = [(i, f"Posted in the news by {p} under general topics\n{sentences(i, 9)}") for i, p in enumerate(people)]
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(documents(lines)).collect()}
    assert got == {i: int(i > 0) for i in range(len(people))}
    copies = [(i, "The very same text in each of many copies of it") for i in range(30)]
    assert {r.n_dropped for r in line_templates.drop_recurring_lines(documents(copies)).collect()} == {0}


def test_short_and_spaceless_lines_recur(documents):
    recurring = ["All rights reserved.", "Menu", "Page {}", "第{}章 版权所有不得转载本站全部内容", "版权所有不得转载", "one\ttwo\t{}\tfour\tfive"]
    other = ["", "---", "12", "12 13"]
    data = [(i, "\n".join([f"own text {'abcdefghijkl'[i] * 3}", *(x.format(100 + i) for x in recurring), *other])) for i in range(12)]
    rare = [(20 + i, f"Read more\nown {'abcdefghi'[i] * 3}") for i in range(9)]
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_templates.drop_recurring_lines(documents(data + rare), every_line=True).collect()}
    assert got[0] == (0, data[0][1]) and all(got[i] == (0, t) for i, t in rare)
    assert all(got[i] == (len(recurring), "\n".join([t.split("\n")[0], *other])) for i, t in data[1:])


# benchmark

ITEM = "A train leaves the station at 40 km per hour and another one with Anna leaves at 60 km per hour how long until the one of Anna meets it"


def benchmark_table(spark, items):
    return spark.createDataFrame(items, "item_id LONG, text STRING, window LONG") if items else spark.createDataFrame([], "item_id LONG, text STRING, window LONG")


def test_templates_catch_other_numbers_and_check_slots(spark, documents):
    other = ITEM.replace("40", "75").replace("60", "90").replace("Anna", "Bert")
    torn = ITEM.replace("Anna meets", "Carl meets")
    data = list(ODD) + [(1, f"before it {ITEM} after"), (2, f"Some words {other}"), (3, torn), (4, ITEM[:45]), (11, ITEM.upper()), (12, f"{ITEM}. {ITEM}"), (1, f"before it {ITEM} after")]
    benchmark = benchmark_table(spark, [(1, ITEM, 0), (2, None, 0), (3, "too short", 0), (None, sentences(3, 30), 0)])
    got = Counter((r.doc_id, r.item_id, r.verbatim) for r in decontaminate.find_contamination(documents(data), benchmark).collect())
    assert got == Counter({(1, 1, True): 1, (2, 1, False): 1, (12, 1, True): 1})
    left = Counter(r.doc_id for r in decontaminate.decontaminate(documents(data), benchmark).collect())
    assert left == Counter(i for i, _ in data if i not in (1, 2, 12))
    assert decontaminate.find_contamination(documents([]), benchmark).count() == 0
    assert decontaminate.find_contamination(documents(data), benchmark_table(spark, [])).count() == 0


def test_windows_join_by_shuffle_beyond_the_bound(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    got = decontaminate.find_contamination(documents([(1, ITEM), (2, "nothing of it")]), benchmark_table(spark, [(1, ITEM, 0)])).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]


def test_dense_and_short_items_are_found_as_a_whole(spark, documents):
    items = ["What is 12 plus 7 times 3 minus 4?", "Convert 5 km 300 m to m and 20 cm to mm.", "Who wrote Faust?", "42 kg"]
    other = ["What is 15 plus 8 times 2 minus 9?", "Convert 7 km 200 m to m and 30 cm to mm."]
    torn = ["What is 12 plus 7 times 3", "Convert 5 km 300 m to m and 20 cm to ours.", "Who wrote it and Faust?", "43 kg of 42 apples"]
    data = [(i, t) for i, t in enumerate(items)] + [(10 + i, f"some words, then {t} and more of it") for i, t in enumerate(items)]
    data += [(20 + i, f"Before it. {t}") for i, t in enumerate(other)] + [(30 + i, t) for i, t in enumerate(torn)]
    data += [(40, "Tell us: Tom is 12 plus 7 times 3 minus 4?"), (41, "42 kg and 42 kg, of 42 kg"), (42, "then Tom is 12 plus 7 times 3 minus 4?")]
    benchmark = benchmark_table(spark, [(i, t, 0) for i, t in enumerate(items)] + [(7, " . ", 0), (8, "", 0)])
    got = {(r.doc_id, r.item_id, r.n_matched, r.n_windows, r.verbatim) for r in decontaminate.find_contamination(documents(data), benchmark).collect()}
    n = [2, 5, 1, 1]
    want = {(i + at, i, n[i], n[i], True) for i in range(4) for at in (0, 10)} | {(20 + i, i, n[i], n[i], False) for i in range(2)} | {(41, 3, 1, 1, True)}
    assert got == want
    assert {r.doc_id for r in decontaminate.decontaminate(documents(data), benchmark).collect()} == {i for i, _ in data} - {i for i, *_ in want}


# pages

STORY = [f"Paragraph {i} of the story, with some words, and a few commas, to be read by people who like text." for i in range(4)]
PAGES = {
    "plain": "<html><body><div id=nav><a href=/>Home</a></div><article><h1>Title &amp; more</h1>" + "".join(f"<p>{p}</p>" for p in STORY) + "</article></body></html>",
    "divs": "<body><div class='cookie-notice'>We use cookies, you know, and they are tasty, so agree to all of them now please</div><div class=header>Big, head, line</div>"
    "<div id=content><h1>Title &amp; more</h1>" + "".join(f"<p>{p}" for p in STORY) + "</div><div class=sidebar><ul>" + "<li><a href=x>Other, story, here, to, read</a>" * 9 + "</ul></div>"
    "<div id=comments><p>I think, as a reader, that this is good, very good, and more than that, it is long enough.</p></div><footer>&copy; All, rights</footer></body>",
    "script": "<script>if (a < b) document.write('<p>no, no, no</p>')</script><style>p > a {}</style><!-- <p>hidden, text</p> --><main><h1>Title &#38; more</h1>"
    + "<form><label>Name, please</label><input></form>".join(f"<p><b>{p.replace(' of', '  of')}</b></p>\n" for p in STORY) + "</main>",
}


def test_names_of_parts():
    bad = ["post-comments", "article-footer", "page_header", "mainMenu", "ad", "ads-container", "sidebar-content", "comment-body", "cookie-notice"]
    good = ["main-content", "has-sidebar", "article", "postBody", "with-comments", "adult", "headerless", "x1", "content-page"]
    assert [html_text.judged(x) for x in bad] == [-1] * len(bad) and all(html_text.judged(x) >= 0 for x in good)
    assert html_text.described(' data-id="ad" data-hidden="x" class="story has-sidebar"') == (False, 25)


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert html_text.main_text(PAGES[name]) == "\n".join(["Title & more", *STORY])

TEN = "".join(f"<p>{p}</p>" for p in STORY)
TALK = "<p>I like it a lot, as a reader, and I read it more than once, thanks</p>"
WHOLE = ["T", *STORY]
SHAPES = {
    "closing part": (f"<body><div id=wrap><div class=part><h1>T</h1>{TEN}{TEN}</div><div><h2>End</h2>{TALK}</div><h4>s</h4><ul><li>a<li>b</ul>bare</div></body>",
                     [*WHOLE, *STORY, "End", TALK[3:-4], "s", "a", "b", "bare"]),
    "parts in parts": (f"<body><div><div><div><h1>T</h1>{TEN}</div></div><div><div>{TALK}</div></div></div></body>", [*WHOLE, TALK[3:-4]]),
    "links beside": (f"<body><div><div><h1>T</h1>{TEN}</div><div><a href=x>Other story</a> <a href=y>Some more</a></div></div></body>", WHOLE),
    "about others": (f"<body><div class='content-with-sidebar'><h1>T</h1>{TEN}</div></body>", WHOLE),
    "article header": (f"<header>Site</header><article><header><h1>T</h1></header>{TEN}</article>", WHOLE),
    "entry header": (f"<div class=post><div class='entry-header'><h1>T</h1></div>{TEN}</div>", WHOLE),
    "two articles": (f"<main><article><h1>T</h1>{TEN}</article><article>{TALK}</article></main>", [*WHOLE, TALK[3:-4]]),
    "form around all": (f"<body><form action=x><input><label>Find</label><div><h1>T</h1>{TEN}</div></form></body>", WHOLE),
    "form inside": (f"<article><h1>T</h1>{TEN}<form><p>Write to us and tell us all that you think of it</p></form></article>", WHOLE),
    "comment list": (f"<article><h1>T</h1>{TEN}<ol class='commentlist'><li>{TALK}</ol></article>", WHOLE),
    "comment part": (f"<article><h1>T</h1>{TEN}<section><h3>3 Comments</h3>{TALK}</section></article>", WHOLE),
    "comment heading": (f"<article><h1>T</h1>{TEN}<h3>Leave a comment</h3>{TALK}</article>", WHOLE),
    "open quote": (f"<div title=\"a><h1>T</h1>{TEN}</div>", WHOLE),
    "greater in a value": (f"<article data-x='a > b' class=story><h1 title=\"<p>\">T</h1>{TEN}</article>", WHOLE),
}


@pytest.mark.parametrize("name", SHAPES)
def test_whole_articles(name):
    page, want = SHAPES[name]
    assert html_text.main_text(page) == "\n".join(want)


@pytest.mark.parametrize("odd", ["<a", '"', "'", "<", "<!", "<!--", "<div>", "<li>", "</b>", "<b>", '<div class="a', "<a b='\"", "<ul><li><div>", "<td><li><p>", "<script>", "&#1", "<h2>Comments</h2>"])
def test_time_grows_with_the_page(odd):
    import time

    def seconds(length):
        page = TEN + odd * (length // len(odd))
        start = time.process_time()
        html_text.main_text(page)
        return time.process_time() - start

    small, large = seconds(50_000), seconds(400_000)
    assert large < 40 * small + 1.0  # 64 times as much if it grew with the square


def test_references_to_no_character():
    assert html_text.main_text(f"<p>long &#{'1' * 6000}; and &#{'0' * 6000}65; and &#x41; in one paragraph</p>") == "long \ufffd and A and A in one paragraph"


def test_scores_against_their_definition():
    """Points of each paragraph handed out one by one, over generated trees."""
    import random

    rng = random.Random(5)

    def made(depth):
        inner = "".join(made(depth + 1) if depth < 5 and rng.random() < 0.6 else f"<p>{'some words, ' * rng.randint(1, 30)}<a href=x>{'link ' * rng.randint(0, 9)}</a></p>" for _ in range(rng.randint(1, 4)))
        return f"<div class='{rng.choice(['x', 'content', 'story'])}'>{inner}</div>"

    def all_of(node):
        return [node] + [y for x in node.items if isinstance(x, html_text.Element) for y in all_of(x)]

    def texts(node, linked=False):
        for item in node.items:
            if isinstance(item, str):
                yield item, linked
            else:
                yield from texts(item, linked or item.name == "a")

    for _ in range(20):
        root = html_text.parsed(made(0))
        best = html_text.scored(root)
        nodes = all_of(root)
        points = {id(x): float(x.weight) for x in nodes}
        for node in nodes:
            own = sum(len(t.strip()) for x in node.items for t, _ in ([(x, 0)] if isinstance(x, str) else texts(x) if x.name == "a" else []))
            commas = sum(x.count(",") for x in node.items if isinstance(x, str))
            if node.name in html_text.PARAGRAPHS and own >= html_text.LEAST_PARAGRAPH:
                for share, up in ((1, node.parent), (0.5, node.parent.parent)):
                    if up is not None:
                        points[id(up)] += share * (1 + commas + min(own // 100, 30))
        for node in nodes:
            lengths = [(len(t.strip()), linked or node.name == "a") for t, linked in texts(node)]
            share = sum(n for n, linked in lengths if linked) / max(1, sum(n for n, _ in lengths))
            assert node.score == pytest.approx(points[id(node)] * (1 - share))
        assert best.score == max(x.score for x in nodes if x.name in ("div", "html"))


def test_odd_pages(spark):
    deep = "<div>" * 20000 + "deep, text, that is long enough to count" + "</div>" * 20000
    data = [(1, None, None), (2, "u", ""), (3, "u", "just words, no markup, but enough of them"), (4, "u", "<p>unclosed <b>bold<p>next"), (4, "u", "<p>unclosed <b>bold<p>next"), (None, None, "<"), (6, "u", deep), (7, "u", "<script>x")]
    got = html_text.extract_main_text(spark.createDataFrame(data, "page_id LONG, url STRING, html STRING").selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(data) and texts[1] == texts[2] == texts[7] == ""
    assert texts[3].startswith("just words") and texts[4] == "unclosed bold\nnext" and texts[6].startswith("deep")
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id LONG, url STRING, html STRING")).count() == 0


# vectors


def test_vectors_equal_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(2)
    monkeypatch.setattr(neighbours, "LIST", 4)
    data = []
    for group in range(15):
        centre = draw.standard_normal(16)
        for k in range(int(draw.integers(1, 30))):
            data.append((len(data), (centre + 0.06 * draw.standard_normal(16)).tolist(), group % 3))
    data += [(500 + i, data[0][1], 0) for i in range(5)]
    data += [(600, None, 0), (601, [0.0] * 16, 0), (602, [None, *[1.0] * 15], 0), (603, [math.nan] * 16, 0), (604, [math.inf] * 16, 0), (605, data[0][1], None), (None, data[0][1], 0), (606, [], 0), (607, [1.0, 2.0], 0), (608, [2.0, 4.0], 0), (609, [1e300] * 16, 1), (610, [1e-300] * 16, 1)]
    got = neighbours.near_duplicate_vectors(spark.createDataFrame(data, "vec_id LONG, embedding ARRAY<DOUBLE>, label INT").selectExpr("*", "1 AS n", "2 AS rep")).collect()

    def good(row):
        return row[0] is not None and row[2] is not None and row[1] and all(x is not None and math.isfinite(x) for x in row[1]) and any(row[1])

    sound = [(i, np.array(v) / max(map(abs, v)), x) for i, v, x in filter(good, data)]
    links = [(a, b) for k, (a, u, x) in enumerate(sound) for b, v, y in sound[:k] if x == y and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98]
    degree = Counter(x for pair in links for x in pair)
    want = components_of({i for i, _, _ in data if i is not None}, links)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter((i, degree[i] if i is not None else 0, want.get(i)) for i, _, _ in data)
    empty = spark.createDataFrame([], "vec_id LONG, embedding ARRAY<DOUBLE>, label INT")
    assert neighbours.near_duplicate_vectors(empty).count() == 0


@pytest.mark.parametrize("exact", [False, True])
def test_isolated_links_under_a_hot_label_among_many(spark, monkeypatch, exact):
    if exact:
        monkeypatch.setattr(neighbours, "AUDITS", 1)
        monkeypatch.setattr(neighbours, "LEAST_RECALL", 2)
        monkeypatch.setattr(neighbours, "MISS", 0.5)
        monkeypatch.setattr(neighbours, "BLOCK", 500)
    draw = np.random.default_rng(5)
    hot, few = draw.standard_normal((2000, 32)), draw.standard_normal((3000, 32))
    unit = hot[:150] / np.linalg.norm(hot[:150], axis=1, keepdims=True)
    side = draw.standard_normal((150, 32))
    side -= (side * unit).sum(axis=1, keepdims=True) * unit
    pairs = 0.985 * unit + math.sqrt(1 - 0.985**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    data = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([hot, pairs]))] + [(9000 + i, v.tolist(), 1 + i % 150) for i, v in enumerate(few)]
    got = neighbours.near_duplicate_vectors(spark.createDataFrame(data, "vec_id LONG, embedding ARRAY<DOUBLE>, label INT")).where("n_links > 0").collect()
    want = {(i, 1, i) for i in range(150)} | {(2000 + i, 1, i) for i in range(150)}
    missed = len(want - {(r.vec_id, r.n_links, r.component_id) for r in got})
    assert missed <= (0 if exact else 2) and {(r.vec_id, r.n_links, r.component_id) for r in got} <= want
