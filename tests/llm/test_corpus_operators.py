"""Operators against brute force, the public libraries, exact round trips or planted cases; nulls, empties, copies and clashing columns."""

import hashlib
import itertools
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightloom.llm import bpe, decontamination, media, near_duplicates, toxicity, url_filters, warc
from brightloom.llm.language_id import keep_known_language, language_report
from brightloom.llm.near_duplicates import banding, classes, one_of_each
from brightloom.llm.packing import best_fit, empty_bins, pack_documents
from brightloom.llm.queries import URL_RULES, vocabulary
from brightloom.llm.sharding import shard_by_bytes
from brightloom.llm.token_counts import token_report
from brightloom.llm.toxicity import keep_clean, toxicity_report
from brightloom.llm.url_filters import judge
from brightloom.llm.words import PIECE, hashes_of, shingles, word_hashes

TRICKY = [None, "", " ", "\n\n", "Hello world", "Hello  world", "it's  <|endoftext|> fine", "日本語 text 123", "a" * 3000, "x y  z", "tab\tand\r\nline ", "🙂🙂 ok", "don't we'll", "Hello world"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, size string"


def documents(spark, texts, langs=None):
    rows = [(k, t, (langs or {}).get(k, "en"), "s", len(t or ""), "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_counts_equal_the_library(spark, library):
    docs = documents(spark, TRICKY)
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_report(docs, vocabulary()).collect()}
    for k, t in enumerate(TRICKY):
        assert found[k] == (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)), t
    assert token_report(docs.limit(0), vocabulary()).count() == 0


def test_merging_random_texts(library):
    counter, rng = bpe.Counter(bpe.Merges.read(vocabulary())), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abcdeth  'sé\n1.日") for _ in range(rng.randrange(60)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_packing_keeps_every_token(spark, library):
    rng = random.Random(3)
    texts = TRICKY + [" ".join(rng.choice(["data", "spark", "unbelievable"]) for _ in range(rng.choice([3, 50, 700, 5000]))) for _ in range(60)]
    found = pack_documents(documents(spark, texts), vocabulary()).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, r in enumerate(sorted(pieces[k], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert n == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = np.array([r.length for r in found])
    assert -(-lengths.sum() // 2048) <= len(bins) <= len(best_fit(lengths, 2048))  # exchanges never make it worse


def test_exchanges_empty_bins():
    lengths = np.array([6, 4, 4, 3, 3, 6, 2, 2])  # 30 in bins of 10: three are enough
    found = empty_bins([[0, 7], [5, 6], [1, 3], [2, 4]], lengths, 10)
    assert len(found) == 3 and sorted(k for b in found for k in b) == list(range(8))
    assert all(lengths[b].sum() <= 10 for b in found)
    rng = np.random.default_rng(3)
    for _ in range(20):  # the search over all bins is never worse than the one that ends early
        lengths = rng.integers(1, 10, 40)
        early, whole = (empty_bins(best_fit(lengths, 20), lengths, 20, idle) for idle in (1, None))
        assert len(whole) <= len(early) and sorted(k for b in whole for k in b) == list(range(40))


def similar_classes(texts):
    grams = [set(shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(texts)
    for a, b in itertools.combinations(range(len(texts)), 2):
        if grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
            links[a] += 1
            links[b] += 1
            root[max(top(a), top(b))] = min(top(a), top(b))
    return [(top(k), links[k]) for k in range(len(texts))]


def test_join_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "...", "...", "short text", "short text", "Short, text!"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([12, 80, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = documents(spark, texts)
    found = {r.doc_id: (r.class_id, r.n_links) for r in classes(docs, block=4).collect()}
    assert [found[k] for k in range(len(texts))] == similar_classes(texts)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in found.values()}
    assert classes(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "MOST_BROADCAST", 0)
    words = [f"w{k}" for k in range(40)]
    docs = documents(spark, [" ".join(words), " ".join(words[:-1]), " ".join(words), "other words", None]).unionByName(documents(spark, ["again", "again"]).withColumn("doc_id", F.lit(9).cast("long")))
    docs = docs.unionByName(docs.where("doc_id = 9").limit(1))
    assert {r.doc_id: (r.class_id, r.n_links) for r in classes(docs).collect()} == {0: (0, 2), 1: (0, 2), 2: (0, 2), 3: (3, 0), 4: (4, 0), 9: (9, 2)}
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == [0, 3, 4, 9]
    named = docs.withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))  # ids that are no numbers
    assert classes(named).count() == docs.count() and one_of_each(named).count() == 4


def test_banding_meets_its_recall():
    bands, rows = banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


@pytest.mark.parametrize("most", [0, url_filters.MOST_BROADCAST])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(url_filters, "MOST_BROADCAST", most)
    urls = [None, "no scheme", "http://Shop.NET/x", "https://a.example.net/en/1?q", "https://example.net/de/", "http://example.com/de/a#b", "http://www.example.com/fr/", "http://x.org/fr/1", "http://notexample.com/de/", "http://net", "ftp://example.com?x=/de/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, spark.createDataFrame(URL_RULES, "rule string, action string")).collect()}
    assert found[0] == found[1] == ("", "", None, "allow")
    assert found[2] == ("shop.net", "/x", "net/", "block") and found[3] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert found[4][2:] == ("net/", "block") and found[5][1:] == ("/de/a", "example.com/de/", "block") and found[6][2:] == (None, "allow")
    assert found[7][2:] == ("org/fr/", "allow") and found[8][2:] == (None, "allow") and found[9][2:] == (None, "allow") and found[10][:2] == ("example.com", "")


def test_media_round_trip(spark):
    for text in TRICKY + ["é" * 20_000]:
        payload, n = media.padded(text)
        assert len(payload) % 192 == 0 and payload and payload[:n] == (text or "").encode()
        data = media.mux(payload)
        told = media.parse(data)
        assert media.payload_of(data, told) == payload and told["duration"] == len(payload)
    rows = {r.doc_id: r for r in media.document_media(documents(spark, TRICKY)).collect()}
    assert rows[0].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest() and rows[4].media_sha256 == rows[13].media_sha256
    broken = spark.createDataFrame([(bytearray(media.mux(b" " * 192)[:100]),), (None,), (bytearray(),)], "media binary")
    assert all(r.file.problem and not r.file.tracks for r in media.read_boxes(broken).collect())
    assert rows[4].codec == "raw " and rows[4].duration == rows[4].payload_bytes and rows[4].keyframes[0].length == 192


def atom(kind, *parts):
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def plain_track(number, codec, handler, samples, chunk_at):
    """A track written by hand: one chunk of samples of the given sizes, the first and third of them keys."""
    tables = [
        atom(b"stsd", bytes(4), struct.pack(">I", 1), atom(codec, bytes(8))), atom(b"stsz", bytes(4), struct.pack(">II", 0, len(samples)), struct.pack(f">{len(samples)}I", *samples)),
        atom(b"stsc", bytes(4), struct.pack(">I3I", 1, 1, len(samples), 1) if samples else bytes(4)), atom(b"stco", bytes(4), struct.pack(">II", 1, chunk_at) if samples else bytes(4)),
        atom(b"stss", bytes(4), struct.pack(">III", 2, 1, 3)),
    ]
    media_ = atom(b"mdia", atom(b"mdhd", bytes(12), struct.pack(">II", 1000, 0 if not samples else 700), bytes(4)), atom(b"hdlr", bytes(8), handler, bytes(12)), atom(b"minf", atom(b"stbl", *tables)))
    return atom(b"trak", atom(b"tkhd", bytes(12), struct.pack(">I", number), bytes(60)), media_)


def test_tracks_and_fragments_by_hand(spark):
    """A file of two tracks, the second one of fragments, whose bytes aren't made by the module."""
    head = atom(b"ftyp", b"isom", bytes(4))
    first = atom(b"mdat", b"aabbbcccc")
    trex = atom(b"mvex", atom(b"trex", bytes(4), struct.pack(">5I", 2, 1, 40, 5, 0x10000)))
    moov = atom(b"moov", plain_track(1, b"avc1", b"vide", [2, 3, 4], len(head) + 8), plain_track(2, b"mp4a", b"soun", [], 0), trex)
    # three samples of the usual size, of which the first is a key
    moof = lambda at: atom(b"moof", atom(b"traf", atom(b"tfhd", struct.pack(">II", 0x20000, 2)), atom(b"trun", struct.pack(">II", 0x5, 3), struct.pack(">i", at), struct.pack(">I", 0))))
    data = head + first + moov + moof(len(moof(0)) + 8) + atom(b"mdat", b"x" * 15)
    video, sound = media.tracks(data)
    assert (video["codec"], video["duration"], video["keys"].tolist(), video["at"].tolist()) == ("avc1", 700, [0, 2], [len(head) + 8, len(head) + 10, len(head) + 13])
    assert (sound["codec"], sound["duration"], sound["sizes"].tolist(), sound["keys"].tolist(), sound["at"].tolist()) == ("mp4a", 120, [5] * 3, [0], [len(data) - 15 + 5 * k for k in range(3)])
    (row,) = media.read_boxes(spark.createDataFrame([(bytearray(data),)], "media binary")).collect()
    assert [(t.codec, t.samples, len(t.keyframes)) for t in row.file.tracks] == [("avc1", 3, 2), ("mp4a", 3, 1)] and row.file.problem is None
    with pytest.raises(ValueError):
        media.tracks(data[:-4])


def test_shards(spark):
    docs = documents(spark, TRICKY * 20)
    found = shard_by_bytes(docs).collect()
    assert len(found) == len(TRICKY) * 20
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        text = (TRICKY * 20)[r.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len((text or "").encode()) + 8, zlib.crc32((text or "").encode()), "bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 3008


def manifest(records, per=64):
    number = F.col("page_id")
    made = records.withColumn("record", warc.warc_record(number, F.col("url"), F.col("html"))).drop("html")
    return warc.archived(made, F.floor(number / per), F.pmod(number, F.lit(per)), [number, F.col("url")])


def test_fixity(spark):
    """One changed record, one longer, one lost and one added give just their rows; so do repeated and null ids."""
    rows = [(k, f"http://x/{k}", "body" * (k % 7), k, "clash") for k in range(300)] + [(None, None, None, 0, "clash"), (7, "http://x/7", "body" * 0, 1, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int, digest string")
    damaged = pages.withColumn("html", F.when(F.col("page_id") == 5, F.lit("lost")).when(F.col("page_id") == 250, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    damaged = damaged.where("page_id is null or page_id <> 130").unionByName(spark.createDataFrame([(66, "http://x/new", "new", 0, "")], pages.schema))
    whole, again, other = manifest(pages), manifest(pages.orderBy(F.rand(3))), manifest(damaged)
    assert warc.fixity_report(whole, again, 4, 3).count() == 0
    found = {(r.about.page_id, r.about.url): r for r in warc.fixity_report(whole, other, 4, 3).collect()}
    assert {k[0]: r.status for k, r in found.items()} == {5: "changed", 250: "changed", 130: "missing", 66: "extra"}
    assert found[66, "http://x/new"].seq is None and found[5, "http://x/5"].about.offset == 5
    assert {r.status for r in warc.fixity_report(whole, manifest(pages.limit(0)), 4, 3).collect()} == {"missing"}
    assert sum(r.copies for r in warc.fixity_report(manifest(pages.limit(0)), whole, 4, 3).collect()) == len(rows)
    assert warc.fixity_report(manifest(pages.limit(0)), manifest(pages.limit(0)), 4, 3).count() == 0


def test_fixity_of_displaced_records(spark):
    whole = manifest(spark.createDataFrame([(k, "u", "x") for k in range(64)], "page_id long, url string, html string"))
    moved = whole.withColumn("offset", F.col("offset") + F.when(F.col("slot").between(20, 23), 9).otherwise(0))
    found = warc.fixity_report(whole, moved, 4, 3).collect()
    assert [r.status for r in found] == ["displaced"] and found[0].slot == 16  # the node of slots 16 to 31, where 20 to 23 lie elsewhere


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_languages(spark):
    rng = random.Random(2)
    words = {"en": ["the", "house", "water", "with", "thing", "which"], "de": ["der", "das", "straße", "zwischen", "nicht", "schön"], "fr": ["les", "maison", "être", "avec", "quelque", "où"]}
    langs = dict(enumerate(list(words) * 60))
    docs = documents(spark, [prose(rng, words[x], 30) for x in langs.values()] + [None, "", "123 !!"], langs)
    rows = language_report(docs).collect()
    assert [r.lang_pred for r in sorted(rows, key=lambda r: r.doc_id)][-3:] == ["und"] * 3
    assert all(r.lang_pred == langs[r.doc_id] and 0 <= r.score <= 1 for r in rows if r.doc_id in langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    kept = keep_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(langs)
    assert language_report(docs.limit(0)).count() == 0


def test_toxic_spans(spark):
    rng = random.Random(4)
    plain, foul = [f"word{k}" for k in range(200)], ["grumblefoot", "stinkweasel", "snotgobbler"]
    toxic = [k % 3 == 0 for k in range(600)]
    texts = [prose(rng, plain, 60) + (f" you {rng.choice(foul)} {rng.choice(foul)} " if t else " ") + prose(rng, plain, 60) for t in toxic]
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(k, int(t)) for k, t in enumerate(toxic)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity_report(docs, labels).collect()}
    assert sum(rows[k].predicted != int(t) for k, t in enumerate(toxic)) <= 6
    spans = [texts[0][s.start : s.end] for s in rows[0].spans]
    assert spans and set(spans) <= {*foul, "you"}
    assert rows[600].score == rows[601].score == 0 and keep_clean(docs, labels).columns == docs.columns
    assert {r.score for r in toxicity_report(docs, labels.limit(0)).collect()} == {0.0}


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(0)
    e, start, step = rng.normal(size=9), rng.normal(size=2), rng.normal(size=(2, 2))
    first = np.zeros(9, bool)
    first[[0, 4]] = True
    found = toxicity.marginals(e, first, start, step)
    for a, b in ((0, 4), (4, 9)):
        sums = np.zeros((b - a, 2))
        for path in itertools.product((0, 1), repeat=b - a):
            w = start[path[0]] + sum(step[i, j] for i, j in itertools.pairwise(path)) + sum(x * y for x, y in zip(e[a:b], path, strict=True))
            for k, y in enumerate(path):
                sums[k, y] += np.exp(w)
        assert np.allclose(found[a:b], sums[:, 1] / sums.sum(1))


def test_common_subsequence():
    rng = random.Random(7)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in "ab")
        masks = defaultdict(int)
        for k, w in enumerate(a):
            masks[w] |= 1 << k
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontamination.common_length(masks, len(a), b) == table[-1, -1]


def test_benchmark_passages(spark):
    rng = random.Random(6)
    words = [f"term{k}" for k in range(900)]
    items = [prose(rng, words, 40) for _ in range(8)] + ["two words"]
    benchmark = spark.createDataFrame([*enumerate(items), (99, None), (None, "x")], "item_id long, text string")
    clean = [prose(rng, words, 200) for _ in range(60)]
    reworded = items[1].split()
    reworded[5] = reworded[20] = "changed"
    leaks = [clean[0] + " " + items[0].upper() + " " + clean[1], clean[2] + " " + " ".join(reworded), "say two, words now"]
    docs = documents(spark, [*clean, *leaks, None, ""])
    found = {(r.doc_id, r.item_id) for r in decontamination.contamination_report(docs, benchmark).collect()}
    assert found == {(60, 0), (61, 1), (62, 8)}
    kept = decontamination.keep_uncontaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontamination.keep_uncontaminated(docs, benchmark.limit(0)).count() == docs.count()


def passages(items, space, held=None):
    """The index of items (id, text), as the operator's Spark job makes it."""
    rows = pa.record_batch([pa.array(range(len(items))), pa.array([k for k, _ in items], pa.int64()), pa.array([t for _, t in items])], ["row", "item_id", "text"])
    held = np.ones(1 << decontamination.BITS, np.int64) if held is None else held
    return decontamination.index_passages(pa.Table.from_batches(list(decontamination.cut(iter([rows])))), space, held)


def test_copies_without_the_projection():
    rng = random.Random(11)
    words = [f"term{k}" for k in range(900)]
    items = [prose(rng, words, n) for n in (8, 10, 12, 15, 24, 29, 50)]
    space = np.zeros((1 << decontamination.BITS, decontamination.RANK), np.float32)
    index = passages(list(enumerate(items)), space)
    for k, item in enumerate(items):
        texts = [f"{prose(rng, words, 40 + offset)} {item} {prose(rng, words, 60)}" for offset in range(8)]
        found = decontamination.found_in(list(hashes_of(texts)), index, space)
        assert [[(m["item_id"], m["kind"]) for m in f] for f in found] == [[(k, "copy")]] * 8


def leaks(words, item):
    """Brute force: whether some stretch of a text holds enough of some passage of an item, from tables of common subsequences."""
    whole = word_hashes(item).tolist()
    most = next((n for n in decontamination.PASSAGES if len(whole) < n * 3 // 2), decontamination.PASSAGES[-1])
    last = max(0, len(whole) - most)
    answer = set(decontamination.answer_words(item).tolist())
    for at in {*range(0, last, most // 2), last}:
        part = whole[at : at + most]
        masks = defaultdict(int)
        for k, w in enumerate(part):
            masks[w] |= 1 << k
        reach = len(part) + 2 * decontamination.SLACK
        for start in range(max(1, len(words) - reach + 1)):
            common = decontamination.common_length(masks, len(part), words[start : start + reach]) / len(part)
            near = answer.intersection(words[max(0, start - len(whole)) : start + reach + len(whole)])
            if common >= decontamination.STRONG or (common >= decontamination.WEAK and len(near) >= decontamination.ANSWER * len(answer)):
                return True
    return False


def test_paraphrases_against_brute_force(spark):
    """Recall of reworded items (a fifth to three tenths of the words replaced, left out or added) is 0.9 or more; nothing else is found."""
    rng = random.Random(12)
    words = [f"term{k}" for k in range(4000)] + ["the", "of", "and", "to", "in"] * 300
    items = [prose(rng, words, rng.choice([16, 20, 30, 45, 60])) for _ in range(40)]
    texts = [prose(rng, words, rng.choice([5, 60, 150])) for _ in range(120)]
    for k in range(160):
        reworded = []
        for w in items[k % 40].split():
            turn = rng.random() / (0.2 + 0.1 * (k % 2))
            reworded += [] if turn < 0.25 else [rng.choice(words)] if turn < 0.75 else [w, rng.choice(words)] if turn < 1 else [w]
        texts.append(f"{prose(rng, words, 30 + k % 4)} {' '.join(reworded)} {prose(rng, words, 50)}")
    hashed = [w.tolist() for w in hashes_of(texts)]
    true = {(d, i) for d, w in enumerate(hashed) for i, item in enumerate(items) if leaks(w, item)}
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contamination_report(documents(spark, texts), benchmark).collect()}
    assert len(true) >= 120 and found <= true and len(found) >= 0.9 * len(true)


def test_hashing_together():
    texts = TRICKY + ["x" * (PIECE + 5), "ab " * (PIECE // 2), "İstanbul ǅ"] + TRICKY
    assert all(np.array_equal(a, word_hashes(t)) for a, t in zip(hashes_of(texts), texts, strict=True))
    assert len(word_hashes(texts[15])) == PIECE // 2 and len(set(word_hashes(texts[15]).tolist())) == 1  # words over the edges of pieces


def edge_operators(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    benchmark = spark.createDataFrame([(1, "one passage of a benchmark that nobody else would ever write in just this way")], "item_id long, text string")
    return {
        "language": language_report, "toxicity": lambda d: toxicity_report(d, labels), "media": media.document_media, "join": classes, "shards": shard_by_bytes, "counts": lambda d: token_report(d, vocabulary()),
        "packing": lambda d: pack_documents(d, vocabulary()).where("piece = 0"), "clean": lambda d: keep_clean(d, labels), "uncontaminated": lambda d: decontamination.keep_uncontaminated(d, benchmark),
    }


@pytest.mark.parametrize("name", ["language", "toxicity", "media", "join", "shards", "counts", "packing", "clean", "uncontaminated"])
def test_null_ids_and_repeated_rows(spark, name):
    """Null ids and rows that repeat as a whole give a row each; an empty table gives none."""
    operator = edge_operators(spark)[name]
    docs = documents(spark, ["some words that are here", "more words", None, ""])
    rows = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    found = operator(rows).select("doc_id").collect()
    assert len(found) == 12 and sum(r.doc_id is None for r in found) == 4
    assert operator(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns and left.count() >= 0.7 * docs.count(), name
        docs = left


def test_every_setting_packs_whole(spark, monkeypatch):
    rng = random.Random(8)
    texts = [None, ""] + [" ".join(rng.choice(["data", "spark", "unbelievable"]) for _ in range(rng.choice([3, 20, 90, 300]))) for _ in range(150)]
    docs = documents(spark, texts)
    sizes = []
    for settings in ({}, {"idle": None}, {"idle": 0, "reopened": 0.5}, {"group": 20}, {"group": 20, "reopened": 0.0}):
        found = pack_documents(docs, vocabulary(), 256, **settings).collect()
        bins = defaultdict(list)
        for r in found:
            bins[r.sequence_id].append((r.offset, r.length))
        for members in bins.values():
            assert [o for o, _ in sorted(members)] == list(itertools.accumulate([n for _, n in sorted(members)], initial=0))[:-1]
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == (sizes[0][1] if sizes else sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found))
        sizes.append((len(bins), sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)))
    least = -(-sum(n for *_, n, _ in sizes[0][1]) // 256)
    assert least <= sizes[1][0] <= sizes[0][0] <= sizes[2][0] and sizes[3][0] <= sizes[4][0]  # round two never makes more


def test_broken_files_are_told(spark):
    whole = media.mux(media.padded("hello")[0])
    rows = spark.createDataFrame([(1, None), (2, b""), (3, b"abcd"), (4, whole[: len(whole) // 3]), (5, whole)], "id int, media binary")
    found = {r.id: r.digest for r in media.media_digest(rows).collect()}
    assert found[1].media_bytes is None and found[1].problem == "no bytes" and found[2].media_bytes == 0
    assert all(found[k].payload_sha256 is None and found[k].problem for k in (2, 3, 4))
    assert found[5].problem is None and found[5].payload_bytes == 192 and found[5].payload_sha256 == hashlib.sha256(b"hello".ljust(192)).hexdigest()


def test_media_round_trip_of_texts(spark):
    texts = [*TRICKY, "x" * 192, "é" * 96, "y" * 193]
    rows = {r.doc_id: r for r in media.document_media(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        file = media.mux(media.padded(t)[0])
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest()) and r.problem is None
    assert rows[TRICKY.index("Hello world")].feature == rows[len(TRICKY) - 1].feature


def test_chain_in_slices_is_the_same(monkeypatch):
    rng = random.Random(2)
    windows = [[rng.choice(["good", "bad", "awful", "fine", "words"]) for _ in range(rng.choice([5, 40]))] for _ in range(60)]
    states = [np.array([int(t in ("bad", "awful")) for t in w]) for w in windows]
    whole = toxicity.fit_chain(windows, states)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    parts = toxicity.fit_chain(windows, states)
    assert whole.weights.keys() == parts.weights.keys() and all(abs(whole.weights[f] - parts.weights[f]) < 1e-6 for f in whole.weights)
    assert np.allclose(whole.step, parts.step) and whole.emission("bad") > 2 > -2 > whole.emission("good")


def test_marginals_beyond_a_block():
    rng = np.random.default_rng(5)
    e, first, step = rng.normal(size=3 * toxicity.BLOCK + 17), rng.normal(size=2), rng.normal(size=(2, 2))
    up, t = np.stack([np.ones(len(e)), np.exp(e)], 1), np.exp(step)
    alpha, beta = [np.exp(first) * up[0]], [np.ones(2)]
    for k in range(1, len(e)):
        alpha.append((alpha[-1] @ t) * up[k])
        alpha[-1] /= alpha[-1].sum()
        beta.append(t @ (up[-k] * beta[-1]))
        beta[-1] /= beta[-1].sum()
    both = np.array(alpha) * np.array(beta[::-1])
    begins = np.zeros(len(e), bool)
    begins[0] = True
    assert np.allclose(toxicity.marginals(e, begins, first, step), both[:, 1] / both.sum(1), atol=1e-9)
