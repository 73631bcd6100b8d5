"""Language, quality, personal data, decontamination, archives and the pipeline."""

import base64
import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from segtide.llm import crf, decontam, langid, queries, rules, warc
from segtide.session import shared_dir
from tests.llm.conftest import PROSE, ROWS, pairs, rows_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.train(docs.where(~queries.held_out()))).where(queries.held_out())
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 300 and right > 0.98
    assert got.where("score < 0 or score > 1").isEmpty()


def test_language_of_messy_rows(messy, no_rows, documents):
    model = langid.train(documents)
    got = [(r.doc_id, r.text, r.lang_pred, r.score) for r in langid.identify(messy, model).collect()]
    assert sorted((g[:2] for g in got), key=repr) == sorted(ROWS, key=repr)
    for _, text, lang, score in got:
        if text is None or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0)
        else:
            assert lang in ("en", "fr", "de", "es") and 0 <= score <= 1
    assert langid.train(no_rows) is None and langid.identify(no_rows, model).count() == 0
    assert {r.lang_pred for r in langid.identify(messy, None).collect()} == {"und"}


def test_codewords_differ():
    code = langid.codewords(5, 20)
    assert all((code[i] != code[j]).sum() >= 5 for i in range(5) for j in range(i))
    assert (abs(code.sum(0)) < 5).all()


def brute_stats(text):
    w = WORD.findall(text)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


@pytest.mark.parametrize("table", ["messy", "documents", "no_rows"])
def test_statistics(request, table):
    docs = request.getfixturevalue(table)
    assert rows_of(rules.text_stats(docs)) == sorted([(d, *brute_stats(t)) for d, t in pairs(docs)], key=repr)


def test_rules_reject_what_labels_call_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rules.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed")
    assert got.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.1
    assert got.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.98


def test_rules_without_labels_are_the_base(spark, messy):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    got = rules.quality_rules(messy, none)
    assert got.count() == len(ROWS) and got.where("kept = base_failed").isEmpty()


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


TRICKY = ["a@b a@b.c @x.y a..b@c-d.e.f. x@y.z@w.v", "1.2.3.4.5.6.7.8.9 1.2.3 256.1.1.1 0001.2.3.4 1..2.3.4",
          "4111-1111-1111-1111 41111111111111111111 0000000000000000 4111 1111 1111 1111 2", "+1() +12 +1 234 567 89 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6"]


def test_fixed_patterns(documents):
    for text in TRICKY + [t for _, t in pairs(documents)] + [t or "" for _, t in ROWS]:
        assert crf.base_spans(text) == brute_base(text)


@pytest.fixture(scope="module")
def field():
    return crf.train()


def test_field_learns_its_table(field):
    table = crf.labelled_table(copies=3, seed=50)
    right = [[crf.LABELS[i] for i in path] == labels for (_, labels), path in zip(
        table, field.decode([field.scores(w) for w, _ in table]))]
    assert sum(right) / len(right) > 0.95


def test_field_adds_and_keeps(field):
    texts = ["write to maria at mail dot example dot org today", "call (555) 010-4477 now", "released on 2023-11-05 at 12:45",
             "mail a@b.org now"]
    found = crf.find_all(texts, field)
    assert found[0] == [("email", 9, 42, False)] and found[1] == [("phone", 5, 19, False)] and not found[2]
    assert found[3] == [("email", 5, 12, True)]


@pytest.mark.parametrize("kind, value", [(k, v) for k in crf.KINDS for v in crf.VALUES[k]])
def test_every_form_in_a_line_without_other_signs(kind, value, field):
    sentence = next(s for s in crf.SENTENCES if s.count("{") == 1 and f" {{{kind}}} " in s)
    value = crf.MADE.sub(lambda m: crf.made_up(m, random.Random(value)), value)
    text = f"no sign here\n{sentence.format(**{kind: value})}\nnor here"
    assert any(value in " ".join(w[0] for w in words) for words in crf.windows(text))
    begin = text.index(value)
    if crf._valid(kind, value):
        assert (kind, begin, begin + len(value)) in [s[:3] for s in crf.find_all([text], field)[0]]


def test_secrets_by_their_surroundings(field):
    """Held-out keys in held-out words: a string that machines made is a secret by what stands before it."""
    draw = random.Random(77)
    filler = ["lerin", "thouer", "queles", "ungheit", "ando", "sch.", "été"]
    texts, gold = [], []
    for k in range(400):
        key = crf.MADE.sub(lambda m: crf.made_up(m, draw), draw.choice(["{40}", "{32}", "{64}", "{a32}", "ghp_{a36}"]))
        secret = k % 2 == 0
        before = draw.choice(['token = "', "TOKEN = '", "api_key : ", "secret = ", 'token="'] if secret else
                             ["checksum ", "commit ", "etag ", "sha1 "])
        after = {'"': '"', "'": "'"}.get(before[-1], "")
        text = " ".join(draw.choices(filler, k=draw.randint(0, 30))) + " " + before
        gold.append({("secret", len(text), len(text) + len(key), False)} if secret else set())
        texts.append(text + key + after + " " + " ".join(draw.choices(filler, k=draw.randint(0, 30))))
    found = [set(s) for s in crf.find_all(texts, field)]
    right = sum(len(f & g) for f, g in zip(found, gold))
    assert right >= 0.95 * sum(map(len, gold)) and right >= 0.95 * sum(map(len, found))


def test_secrets_of_the_given_documents(spark, field):
    """The query's own columns over whole documents: every planted key is found, nothing else is added, the base is the patterns'."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.QUERIES["op10_personal_data"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and sum(r.n_added for r in got) > 0
    for r in got:
        text = docs[r.doc_id]
        keys = [m.span(1) for m in re.finditer('token = "([0-9a-f]{40})"', text, re.I)]
        base = [f"{k}:{a}:{b}" for k, a, b in brute_base(text)]
        assert r.spans == ",".join(base + [f"secret:{a}:{b}" for a, b in keys])
        assert (r.n_added, r.n_spans) == (len(keys), len(base) + len(keys))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_long_runs_take_linear_time(field):
    for text in ("a-" * 500_000 + "1", "a_1" * 400_000, "token = " + "x" * 1_000_000 + "1 end"):
        assert len(crf.find_all([text], field)) == 1


@pytest.mark.parametrize("at", ["@", " at ", " AT ", "(at)", " [at] ", " (At) "])
@pytest.mark.parametrize("dot", [".", "[.]", "(.)", " [.] ", " dot ", "(dot)", " [Dot] "])
def test_lines_with_a_valid_address_are_seen(at, dot):
    address = f"maria{at}example{dot}com"
    assert crf._valid("email", address) and crf._NEEDED.search(f"write to {address} soon")


def test_personal_data_of_messy_rows(messy, no_rows, field):
    got = crf.find_personal_data(messy, field)
    assert rows_of(got.select("doc_id", "text")) == sorted(ROWS, key=repr)
    for r in got.collect():
        assert [tuple(s)[:3] for s in r.spans if s.base] == brute_base(r.text or "")
        assert (r.redacted is None) == (r.text is None)
    mail = got.where("doc_id = 14").first().redacted
    assert mail == "mail [EMAIL] or [PHONE], card [CARD], host 10.0.0.256 and [IP]"
    digest = crf.digest(got).where("doc_id = 14").first()
    assert (digest.n_email, digest.n_phone, digest.n_card, digest.n_ip) == (1, 1, 1, 1)
    assert crf.digest(got).where("doc_id = 2").first().base_sha256 == hashlib.sha256(b"").hexdigest()
    assert crf.find_personal_data(no_rows, field).count() == 0


def test_benchmark_items_are_found(spark, messy, no_rows):
    filler = " ".join(f"filler{i} noise{i * 7 % 31}" for i in range(200))
    item = "What is the tallest tower in the northern harbour of the old city of Veldt? The tallest tower is the beacon of Arn."
    changed = item.replace("tallest", "highest").replace("old city", "ancient city")
    docs = spark.createDataFrame([(1, filler + " " + item + " " + filler), (2, filler), (3, changed + "\n" + filler), (4, None),
                                  (None, item), (5, item.upper()), (5, item)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, None), (None, item), (9, "too short"), (10, PROSE)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 7), (3, 7), (5, 7)}
    assert {r.doc_id for r in decontam.contaminated(messy, items).collect()} == {1, 5, 6, 13}
    assert decontam.contaminated(no_rows, items).count() == 0
    assert decontam.contaminated(docs, items.where("item_id < 0")).count() == 0


def test_whole_items_in_documents(spark):
    def plain(text):
        return f" {' '.join(re.sub(r'[^\w]+', ' ', text.lower()).split())} "

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts = [(d, plain(t)) for d, t in pairs(docs)]
    wanted = {(d, r.item_id) for r in items.collect() for d, t in texts if plain(r.text) in t}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == wanted


def made_up(seed, n, kinds=4000):
    """A text of made-up words, some of them frequent."""
    draw = random.Random(seed)
    return " ".join(f"w{int(kinds * draw.random() ** 3)}" for _ in range(n))


def test_item_copied_into_many_documents_is_found(spark):
    item, other = made_up("one", 36), made_up("two", 36)
    docs = [(d, made_up(d, 150)) for d in range(300)] + [(1000 + d, item) for d in range(100)]
    docs += [(2000, made_up(7, 60) + " " + item + " " + made_up(8, 60)), (2001, other)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                spark.createDataFrame([(1, item), (2, other)], "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.where("cosine > 0.35").collect()} == {(1000 + d, 1) for d in range(100)} | {(2000, 1), (2001, 2)}


@pytest.mark.parametrize("n_items", [40, 700])
def test_no_match_is_lost_before_the_check(spark, n_items):
    """Items planted as they are, and with words replaced, half of them beside a text that repeats one sentence."""
    draw = random.Random(n_items)
    items = {k: made_up(f"item {k}", draw.randint(15, 59)) for k in range(n_items)}
    docs = []
    for k, item in items.items():
        words = [w if draw.random() > 0.15 * (k % 3) else f"other{draw.randint(0, 99)}" for w in item.split()]
        beside = made_up(f"loud {k}", 6) + " "
        around = beside * 12 if k % 2 else made_up(f"around {k}", 300) + " "
        docs.append((k, around + " ".join(words) + " " + around))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8),
                                spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    found = {(r.doc_id, r.item_id): r.common_share for r in got.collect()}
    assert all((k, k) in found for k in items if k % 3 == 0)


@pytest.mark.parametrize("n_items, cells", [(30, 4_000_000), (30, 400)])
def test_bound_on_common_words_loses_nothing(n_items, cells):
    draw = np.random.default_rng(n_items)
    items = [(1 + 300 * draw.random(draw.integers(3, 60)) ** 3).astype(int) for _ in range(n_items)]
    frequency = np.bincount(np.concatenate(items), minlength=302) * draw.integers(1, 5, 302)
    space = decontam.Space([], items, [], items, frequency, 24, np.zeros(n_items, bool), np.zeros((302, 1)), np.zeros((n_items, 1)))
    reach = np.where(np.arange(n_items) % 5, 4, 6)
    bound = decontam.CommonWords(space, 0.55, reach, cells)
    matches = 0
    for d in range(60):
        words = (1 + 300 * draw.random(draw.integers(0, 700)) ** 3).astype(int)
        if d % 2:
            words = np.concatenate([words, items[d % n_items][draw.random(len(items[d % n_items])) > 0.3], words[:50]])
        near = set(bound.near(words, 24))
        for k, item in enumerate(items):
            for first in range(max(-(-len(words) // 24) - reach[k] + 1, 1)):
                part = words[first * 24:(first + reach[k]) * 24].tolist()
                if decontam.common_subsequence(decontam._masks(item), len(item), part) >= 0.55 * len(item):
                    matches += 1
                    assert (first, k) in near
    assert matches > 30


def test_frequent_words_alone_give_no_stretch():
    """Half of an item's words are in every document; only where its other words are too is it compared."""
    draw = random.Random(5)
    items = {k: " ".join(f"the{i}" if i % 2 else f"own{k}x{i}" for i in range(30)) for k in range(40)}
    texts = [" ".join(f"the{draw.randint(0, 29)}" if draw.random() < 0.5 else f"t{draw.randint(0, 999)}" for _ in range(300)) for _ in range(200)]
    texts += [f"{texts[k]} {items[k]} {texts[k]}" for k in range(10)]
    number = {}
    coded = [np.array([number.setdefault(w, len(number) + 1) for w in t.split()]) for t in [*items.values(), *texts]]
    passages = [np.unique(t[a:a + 30]) for t in coded[40:] for a in range(0, len(t), 30)]
    frequency = np.bincount(np.concatenate(passages), minlength=len(number) + 1)
    items, coded = coded[:40], coded[40:]
    telling = decontam.telling_words(items, frequency, 0.05 * len(passages))
    space = decontam.Space([], items, [], telling, frequency, 30, np.zeros(40, bool), np.zeros((len(number) + 1, 1)), np.zeros((40, 1)))
    bound = decontam.CommonWords(space, 0.55, np.full(40, 4))
    assert [{k for _, k in bound.near(t, 30)} for t in coded] == [set()] * 200 + [{k} for k in range(10)]
    alone = [(d, first, k) for d, t in enumerate(coded) for first, k in bound.near(t, 30)]
    empty = np.empty(0, int)
    assert sorted(bound.near_any(coded, 30)) == alone and [*bound.near_any([empty, coded[200], empty], 30)] == [(1, *f) for _, *f in alone if _ == 200]


def test_sketch_of_passages_is_right_and_small():
    draw = np.random.default_rng(3)
    size, columns = 500, 64
    omega = draw.standard_normal((size, columns), dtype=np.float32)
    numbers = (size * draw.random(60_000) ** 3).astype(np.uint32)
    places = np.sort(np.concatenate([draw.integers(0, 3000, 50_000), np.full(10_000, 4000)]))  # one passage is longer than a piece
    counted = np.zeros((4001, size))
    np.add.at(counted, (places, numbers), 1)
    total = np.zeros((size, columns))
    tracemalloc.start()
    decontam._add_gram(total, omega, numbers, places, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    wanted = counted.T @ (counted @ omega.astype(float))
    assert np.abs(total - wanted).max() < 1e-4 * np.abs(wanted).max()
    assert peak < 60_000 * columns * 4 / 2
    decontam._add_gram(total, omega, numbers[:0], places[:0])


def test_items_of_every_length_are_found(spark):
    lengths = [1, 2, 3, 5, 7, 8, 12, 24, 60, 180, 900]
    items = {n: " ".join(f"only{n}x{i % 400}" for i in range(n)) for n in lengths} | {24 + i: made_up(f"short {i}", 24) for i in range(1, 30)}
    items[1000] = "in the made up"
    docs = [(n, f"{made_up(n, 333)} {text.upper()}. {made_up(n + 5, 200)}") for n, text in items.items()]
    docs += [(5000 + n, text) for n, text in items.items()]
    docs += [(9000, "only3x0 only3x2 only3x1"), (9001, "made up in the"), (9002, "only2x0 other only2x1")]  # no whole item
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(
        [*items.items(), (2000, " .. ")], "item_id bigint, text string"))
    rows = {(r.doc_id, r.item_id): r for r in got.collect()}
    assert set(rows) == {(d + n, n) for n in items for d in (0, 5000)}
    assert all(r.common_share == 1 for r in rows.values()) and rows[3, 3].word_at == 333


@pytest.mark.parametrize("a, b, n", [("", "abc", 0), ("abc", "abc", 3), ("abcbdab", "bdcaba", 4), ("aaaa", "aa", 2)])
def test_common_subsequence(a, b, n):
    masks = {}
    for i, c in enumerate(a):
        masks[ord(c)] = masks.get(ord(c), 0) | 1 << i
    assert decontam.common_subsequence(masks, len(a), [ord(c) for c in b]) == n


PAGES = [(1, "http://www.B.org/x?q=1", "<p>é\r\n\r\nWARC/1.1</p>"), (2, "https://a.b.org/", "<p>é\r\n\r\nWARC/1.1</p>"), (3, None, None), (4, "u", ""),
         (4, "u", ""), (None, "u", "<p>lone</p>"), (None, "u", None), (5, "http://b.org/x", "z\nz" * 1000)]


@pytest.mark.parametrize("least", [0, 10])
def test_archives_give_pages_back(spark, least):
    pages = spark.createDataFrame([(*p, 9) for p in PAGES], "page_id bigint, url string, html string, payload_bytes int")
    got = warc.archive_pages(pages, shared_dir(spark, "test_warc"), min_bytes=least)
    first = {}
    for p, _, h in sorted(PAGES, key=lambda r: (r[0] is None, r[0] or 0)):
        if len((h or "").encode()) >= least:
            first.setdefault(h or "", p)
    wanted = []
    for p, _, h in PAGES:
        b, owner = (h or "").encode(), first.get(h or "")
        again = p is not None and owner is not None and p != owner
        wanted.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
                       owner if again else None))
    assert rows_of(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == sorted(wanted, key=repr)
    ordered = [(r.url_key, r.timestamp) for r in got.orderBy("range_no", "rank").collect()]
    assert ordered == sorted(ordered)


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string"), shared_dir(spark, "test_warc")).count() == 0


@pytest.mark.parametrize("k", range(1, 8))
def test_loser_tree_merges(k):
    rows = [("k", f"{(i * 7919) % 101:03d}", i, None, None, None, None, 0, "f", 0) for i in range(60)]
    runs = [sorted(rows[i::k], key=warc._order) for i in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(rows, key=warc._order)
    assert list(warc.LoserTree([])) == []


def test_url_keys():
    assert warc.url_key("https://WWW.Example.com/A?b") == "com,example)/a?b"
    assert warc.url_key("") == ")/" and warc.url_key("http://x.org") == "org,x)/"


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(
        [(d, t, "en", "s", len(t) if t else None) for d, t in ROWS if d != 11], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, out, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 1 in ids and 5 not in ids and 6 in ids and 2 not in ids and 7 not in ids and 14 in ids
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    clean = corpus_pipeline.personal_data(spark, docs, "/root/testdata/sf0.001")
    assert "[EMAIL]" in clean.where("doc_id = 14").first().text and clean.count() == docs.count()


def test_whole_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = {r.doc_id: r.text for r in got.collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < len(left) < docs.count()
    for d, t in pairs(docs):
        if d in left and not brute_base(t):
            assert left[d] == t
        assert d not in left or not brute_base(left[d])
