"""Token ids, packing and sentence units."""

import base64
import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

from strandlog.llm import bpe, mail, packing, sentences  # noqa: E402

EDGES = [
    "", " ", "  ", "a  b", "  'stop", "a\n\nb", "a \n", "\n\n", "x 　 y  z", "<|endoftext|> hi", "don't we'LL it''s", "ab" * 900 + "é" * 400, "a" * 5000, "é  \t\tq", "1234  56", "​  ​ x",
    "\x1c\x1d a\x1f\x1fb", " '  's", "नमस्ते दुनिया। ", "สวัสดีครับ คุณ", "合唱团能不能？", "👩‍🔬🧪  👋🏽", "a\r\n\r\nb", "﻿x", "=" * 300, "M??((9>/B306@BT0L", "  \u0085 x",
]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_of_edge_cases(reference):
    enc = bpe.Encoder.of(P.path(bpe.VOCABULARY))
    r = random.Random(0)
    mixed = ["".join(r.choice(["a", "B", " ", "  ", "\n", "'s", "9", "é", "中", "।", "-", " ", "ing", "Ġ"]) for _ in range(r.randrange(60))) for _ in range(300)]
    texts = EDGES + mixed
    assert enc.encode(pa.array(texts)).to_pylist() == [reference.encode_ordinary(t) for t in texts]


def test_ids_equal_the_second_library_too():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(bpe.VOCABULARY))
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch(EDGES, add_special_tokens=False)]
    assert bpe.Encoder.of(P.path(bpe.VOCABULARY)).encode(pa.array(EDGES)).to_pylist() == want


def merged(enc, words):
    flat, n = enc.words(pa.array(words))
    ends = np.cumsum(n)
    return [flat[b - k : b].tolist() for b, k in zip(ends, n)]


def test_recursion_finds_every_token(reference):
    enc = bpe.Encoder.of(P.path(bpe.VOCABULARY))
    ids = {}
    for raw, i in reference._mergeable_ranks.items():
        try:
            ids[raw.decode()] = i
        except UnicodeDecodeError:
            pass  # part of a character, never a word
    words = list(ids)
    assert len(words) > 40_000 and merged(enc, words) == [[ids[w]] for w in words]


def test_long_runs_without_blanks(reference):
    from tokenizers import Tokenizer

    second = Tokenizer.from_file(P.path(bpe.VOCABULARY))
    second.encode_special_tokens = True
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [
        " ".join(letters(1000) for _ in range(100)), " ".join(letters(500) for _ in range(700)), " ".join(letters(300) for _ in range(1300)), letters(100_000), "a" * 100_000, "ab" * 30_000 + "aab" * 5000,
        ",".join("".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(330)) for _ in range(400)), "".join(chr(r.randrange(0xE01, 0xE3A)) for _ in range(30_000)), "=" * 70_001 + " " * 50_000,
    ]
    got = bpe.Encoder.of(P.path(bpe.VOCABULARY)).encode(pa.array(texts)).to_pylist()
    assert got == [reference.encode_ordinary(t) for t in texts] == [e.ids for e in second.encode_batch(texts, add_special_tokens=False)]


def test_both_queries_come_to_the_same_end(monkeypatch):
    enc = bpe.Encoder.of(P.path(bpe.VOCABULARY))
    r = random.Random(9)
    words = ["aaaa" * 40, "abcabd" * 30, "ünïcødé" * 20, "x", *("".join(r.choice("aab") for _ in range(r.randrange(1, 90))) for _ in range(200))]
    want = merged(enc, words)
    for long in (1, 10_000):
        monkeypatch.setattr(bpe, "LONG", long)
        assert merged(enc, words) == want


def test_slices_and_cache_keep_results(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 40)
    rows = [(i, t) for i, t in enumerate([*EDGES, None, None])]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in rows}
    assert bpe.encode_corpus(df.limit(0)).collect() == []
    coded = bpe.encode_corpus(df).unionByName(spark.createDataFrame([(-1, None)], "doc_id long, ids array<int>"))
    assert {r.doc_id: r.text for r in bpe.decode_corpus(coded).collect()} == {-1: None} | {i: t or "" for i, t in rows}
    assert bpe.decode_corpus(coded.limit(0)).collect() == []


def check_patterns(count, capacity):
    used = Counter()
    containers = 0
    for r, lengths in packing.patterns(dict(count), capacity):
        assert r > 0 and 0 < sum(lengths) <= capacity
        containers += r
        for x in lengths:
            used[x] += r
    assert used == Counter({x: n for x, n in count.items() if n and x})
    return containers


@pytest.mark.parametrize("seed", range(6))
def test_patterns_place_everything_tightly(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 64, 256])
    count = Counter(min(capacity, max(1, int(r.expovariate(3 / capacity)))) for _ in range(r.choice([0, 1, 50, 3000])))
    n = check_patterns(count, capacity)
    total = sum(x * k for x, k in count.items())
    ffd = []  # first fit decreasing, one by one
    for x in sorted(count.elements(), reverse=True):
        for i, room in enumerate(ffd):
            if room >= x:
                ffd[i] -= x
                break
        else:
            ffd.append(capacity - x)
    assert -(-total // capacity) <= n <= len(ffd) + max(2, len(ffd) // 50)


def test_exact_complements_fill_completely():
    assert check_patterns(Counter({6: 3, 4: 3, 5: 4, 3: 2, 2: 2, 1: 0}), 10) == 6
    assert check_patterns(Counter({7: 1, 2: 2, 1: 3, 9: 2}), 10) == 4


def test_packed_pieces(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, 0, 3, 3, 3, 3, 10, 11, 25, r.randrange(60)])) for i in range(400)] + [(7, 12), (7, 12)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    boxes = spark.createDataFrame([(1, 10), (2, 64), (3, None), (None, 5), (4, 0)], "size_id int, max_tokens int")
    got = packing.pack(sizes, boxes).collect()
    want = Counter((i, n) for i, n in rows)
    for size, capacity in ((1, 10), (2, 64)):
        mine = [x for x in got if x.size_id == size]
        load = Counter()
        for x in mine:
            load[x.container] += x.n_tokens
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        assert sum(x.n_tokens for x in mine) == sum(n for _, n in rows)
        pieces = Counter((x.doc_id, x.piece) for x in mine)
        for (doc, n), k in want.items():
            for p in range(max(1, -(-n // capacity))):
                assert pieces[doc, p] >= k
        assert all(x.n_tokens == capacity or x.piece == max(y.piece for y in mine if y.doc_id == x.doc_id) or x.doc_id == 7 for x in mine)
    assert {x.size_id for x in got} == {1, 2}
    assert packing.pack(sizes.limit(0), boxes).collect() == []


def test_token_counts(spark, reference):
    df = spark.createDataFrame([(1, "don't stop", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, n_tokens string")
    assert {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()} == {1: 3, 2: 0, 3: 0}


HEAD = "From: a@b.example\nSubject: x\n"


def own(text):
    return ["".join(text[a:z] for a, z in block).strip() for block in mail.own_blocks(text)]


def test_own_text_of_mails():
    assert own(HEAD + "\nHi,\n\nOne.\nTwo.\n") == ["Hi,", "One.\nTwo."]
    assert own(HEAD.replace("\n", "\r\n") + "\r\nHi,\r\n\r\nOne.\r\n") == ["Hi,", "One."]
    assert own(HEAD + "\nA.\n\nOn 1 May, B <b@c.example>\nwrote:\n> q\n> q\n\nC.\n") == ["A.", "C."]
    assert own(HEAD + "\nA.\n> q\nB.\n") == ["A.", "B."]
    assert own(HEAD + "\nA.\n-- \nName\n") == own(HEAD + "\nA.\n--\nName\n") == ["A."]
    for line in ("-----Original Message-----", "---------- Forwarded message ----------", "Begin forwarded message:", "-----元のメッセージ-----"):
        assert own(HEAD + f"\nA.\n\n{line}\nFrom: x\n\nB.\n") == ["A."]
    assert own(HEAD + "\nA.\n\nbegin 644 x.pdf\nM??((9>\n`\nend\n\nB.\n") == ["A.", "B."]
    assert own(HEAD + "Content-Transfer-Encoding: Base64\n\nQQ==\n") == own("no empty line") == own("") == own(HEAD + "\n \n") == []
    multi = HEAD + 'Content-Type: multipart/mixed;\n\tboundary="=_b"\n\nPreamble.\n--=_b\nContent-Type: text/plain; charset=utf-8\n%s\nA.\n\n--=_b\nContent-Type: text/html\n\n<p>A.</p>\n--=_b--\n'
    assert own(multi % "") == ["A."] and own(multi % "Content-Transfer-Encoding: quoted-printable\n") == []


def test_segments_that_need_no_model():
    text = HEAD + "\nDear Dr. X,\n\nSome text. More\n1. one. two\n2. three\n- a\n3. Stock ist\n\nKind regards\nDr. Y\n"
    got = [(k, text[a:z].strip()) for k, a, z in sentences.segments(text)]
    assert got == [("unit", "Dear Dr. X,"), ("text", "Some text. More"), ("unit", "1. one. two"), ("unit", "2. three"), ("unit", "- a"), ("text", "3. Stock ist"), ("unit", "Kind regards\nDr. Y")]


def test_wrongly_decoded_text_keeps_its_places():
    right = "Él pidió «Sí. No.» ¿Y tú? 好的。"
    wrong = "".join(c if ord(c) < 128 else c.encode().decode("latin-1") for c in right)
    back, ends = sentences.mended(wrong)
    assert back == right and ends[-1] == len(wrong) and sentences.mended("plain é") == ("plain é", None)


def corpus(seed, n):
    r = random.Random(seed)
    names = ["Ana", "Bo", "Cleo", "Dag", "Eve"]
    makers = [
        lambda: f"Dr. {r.choice(names)} counted {r.randrange(90)} boxes.", lambda: f"The host answered in {r.randrange(9)}.{r.randrange(99)} s.", lambda: f"We moved it in {r.choice(['Feb.', 'Sept.'])} and again in {r.choice(['Feb.', 'Sept.'])}",
        lambda: f"Is {r.choice(names)} at home?", lambda: f'{r.choice(names)} wrote: "It works. Please go." and went home.', lambda: f"See p. {r.randrange(90)} of the file, e.g. the end.", lambda: "Yes.",
    ]
    thai = [lambda: f"ดูหน้า {r.randrange(99)} ของไฟล์ ได้เลยครับ", lambda: "ขอบคุณมากค่ะ", lambda: f"คุณ {r.choice(['ลูกจันทร์', 'ฟ้าคราม'])} บอกว่าจะนับเองครับ"]
    wide = [lambda: "他问：“什么时候？”", lambda: f"{r.choice(['青柚', '白露'])}说：“好了。走吧。”然后就下班了。", lambda: f"会议{r.randrange(24)}:00开始。", lambda: "太好了！"]
    docs = []
    for i in range(n):
        kind, sep = r.choice([(makers, " "), (makers, " "), (thai, " "), (wide, "")])
        text, ends = HEAD + "\n", []
        for _ in range(r.randrange(1, 4)):
            for k, m in enumerate(r.choices(kind, k=r.randrange(1, 6))):
                text += (sep if k else "") + m()
                ends.append(len(text))
            text += "\n\n"
        docs.append((i, text, ends))
    return docs


def test_model_finds_held_out_boundaries(spark):
    train, held = corpus(1, 1500), corpus(2, 300)
    schema = "doc_id long, text string, end_pos string"
    stats = sentences.statistics(sentences.read_corpus(spark.createDataFrame([(i, t, "") for i, t, _ in train], schema), "doc_id", "text"))
    model = sentences.fit(stats)
    good = found = true = 0
    for _, t, ends in held:
        got = set(sentences.unit_ends(t, model))
        good += len(got & set(ends))
        found += len(got)
        true += len(ends)
    assert good / found > 0.97 and good / true > 0.97


def test_gaps_of_blocks_without_marks(spark):
    r = random.Random(6)
    subject, verb, thing = ["we", "they", "you", "i", "she"], ["moved", "counted", "closed", "opened", "sent"], ["the box", "the file", "a letter", "the door", "the list"]
    sentence = lambda: f"{r.choice(subject)} {r.choice(verb)} {r.choice(thing)} {r.choice(['today', 'again', 'twice', 'quietly'])}"
    docs = [(i, HEAD + "\n" + "\n\n".join(". ".join(x.capitalize() for x in (sentence() for _ in range(r.randrange(1, 5)))) + "." for _ in range(3)) + "\n") for i in range(800)]
    model = sentences.fit(sentences.statistics(sentences.read_corpus(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")))
    good = found = true = 0
    for _ in range(200):
        text, ends = HEAD + "\n", set()
        for _ in range(r.randrange(3, 7)):
            text += sentence()
            ends.add(len(text))
            text += " "
        got = set(sentences.unit_ends(text.rstrip() + "\n", model))
        good, found, true = good + len(got & ends), found + len(got), true + len(ends)
    assert good / found > 0.9 and good / true > 0.9
    short = HEAD + "\nwe moved the box today\n"
    assert sentences.unit_ends(short, model) == [len(short) - 1]


def test_pairs_beyond_the_limit_keep_their_counts(spark, monkeypatch):
    docs = corpus(1, 1500)
    stats = sentences.statistics(sentences.read_corpus(spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string"), "doc_id", "text")).cache()
    whole = sentences.fit(stats)
    monkeypatch.setattr(sentences, "CONTEXTS", 12)
    small = sentences.fit(stats)
    of = lambda m: {c: round(m.total[0][c] + m.total[1][c], 3) for c in m.total[0]}
    assert of(small) == of(whole) and sum(of(whole).values()) == stats.filter("kind = 'c'").agg({"n": "sum"}).first()[0]
    assert len(small.pair[1]) < len(whole.pair[1]) and small.tells.items() <= whole.tells.items()


def test_posteriors_equal_enumeration():
    m = sentences.Model()
    m.event = {"a.": 0.3, "^a.": 0.9, "b.": 0.6, "^b.": 0.2}
    m.known_before = set(m.event)
    m.known_after = {"x", "y"}
    m.start, m.inside = {"Lx": 0.7, "Ly": 0.3}, {"Lx": 0.2, "Ly": 0.8}
    found = [sentences.Place(1, "a.", "w", "L", "x", True, False), sentences.Place(2, "b.", "w", "L", "y", False, True), sentences.Place(3, "a.", "w", "L", "x", False, True)]
    weight = {}
    for code in range(8):
        e = [code >> i & 1 for i in range(3)]
        p, first = 1.0, True
        for i, pl in enumerate(found):
            begins = pl.first or (pl.near and i > 0 and e[i - 1])
            q = m.event[("^" if begins else "") + pl.exact]
            p *= (q if e[i] else 1 - q) * m.word(pl.exact, "L" + pl.next, e[i])
        weight[code] = p
    total = sum(weight.values())
    want = [sum(p for c, p in weight.items() if c >> i & 1) / total for i in range(3)]
    assert np.allclose(m.posteriors(found, True), want)


def test_units_of_dirty_documents(spark):
    blanks = HEAD + "\nOne. Two.\n" + " " * 300 + "three. Four\n\n" + "\t" * 70_000 + "five\n"
    docs = [(7, blanks), (8, HEAD + "\n" + "…" * 100_000 + "a " + "." * 100_000 + "\n"), (1, None), (2, ""), (3, "   "), (4, "no body"), (5, HEAD + "\nOne. Two.\n"), (5, HEAD + "\nOne. Two.\n"), (6, HEAD + "\n" + "word " * 30_000)]
    rows = sentences.sentence_units(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, end_pos int")).collect()
    assert {r.doc_id for r in rows} == {5, 6, 7, 8}
    assert {len(blanks) - 1, blanks.index("\n\n\t")} <= {r.end_pos for r in rows if r.doc_id == 7}
    assert Counter(r.doc_id for r in rows)[6] == 1 and Counter(r.doc_id for r in rows)[5] % 2 == 0
    assert sentences.sentence_units(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_vocabulary_file_is_in_merge_order():
    model = json.load(open(P.path(bpe.VOCABULARY), encoding="utf-8"))["model"]
    assert len(model["merges"]) == 50_000
