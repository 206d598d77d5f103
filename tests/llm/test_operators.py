"""Each operator against a brute-force version, with nulls, empties, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomdex.llm import components, embed_dedup, kneser_ney, licenses, media, mixing, packing, sharding, simhash, tokens, url_cascade, warc

AWKWARD = [None, "", "   ", "a", "a", "Word " * 5000, "é😀 ß\x00\n\tx", "tie", "tie"]


def clash(df):
    """Extra columns with names the operators use themselves."""
    return df.withColumns({c: F.lit(1) for c in ("shard", "slot", "row", "cell", "u", "v", "fp", "k", "length", "rate", "payload", "hexed", "chunks", "n", "id", "seq")})


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "and", "blue", "river", "stone", "walks", "under", "quiet", "morning", "light", "over", "hills", "slow", "bird"]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)]


# 3: sharding


def test_shards(spark, docs_of):
    d = docs_of(AWKWARD + texts(500), ids=[5, 5, None, 3, 4, *range(10, 514)])
    got = sharding.shard_documents(clash(d), 7).collect()
    assert len(got) == d.count()
    sizes = [sum(r["shard"] == s for r in got) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in d.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_documents(d.where("false"), 7).count() == 0
    assert sharding.shard_documents(d, 7).exceptAll(sharding.shard_documents(d.repartition(3), 7)).count() == 0
    plan = sharding.shard_documents(d, 7)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_slots_over_ranges(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_CELL", 20)
    got = sharding.shard_documents(docs_of(texts(900)), 4).collect()
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(225))


def test_communication_matrix_is_exact_and_uniform():
    cells = np.array([10, 0, 37, 5, 900])
    m = sharding.communication_matrix(cells, 7, 3)
    assert (m.sum(axis=1) == cells).all() and set(m.sum(axis=0)) <= {952 // 7, 952 // 7 + 1} and (m >= 0).all()
    mean = np.mean([sharding.communication_matrix(np.array([30, 70]), 4, s)[0] for s in range(400)], axis=0)
    assert np.abs(mean - 7.5).max() < 0.4
    big = sharding.communication_matrix(np.array([3 * 10**9, 10**9]), 2, 1)
    assert big.sum() == 4 * 10**9 and (big.sum(axis=0) == 2 * 10**9).all()


@pytest.mark.parametrize("good, bad, n", [(5, 7, 6), (1, 0, 1), (3, 20, 22), (60, 40, 50), (4 * 10**10, 6 * 10**10, 3)])
def test_hypergeometric_draws_follow_the_law(good, bad, n):
    rng = np.random.default_rng(5)
    draws = np.bincount([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)], minlength=n + 1)
    law = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)])
    assert (draws[law == 0] == 0).all()
    likely = law * 4000 >= 5
    assert ((draws - law * 4000)[likely] ** 2 / (law * 4000)[likely]).sum() < likely.sum() + 5 * (2 * likely.sum()) ** 0.5


def test_hypergeometric_of_billions():
    rng = np.random.default_rng(6)
    x = np.array([sharding.hypergeometric(rng, 2 * 10**9, 6 * 10**9, 10**7) for _ in range(300)])
    sd = (10**7 * 0.25 * 0.75) ** 0.5
    assert abs(x.mean() - 2.5 * 10**6) < 4 * sd / 300**0.5 and 0.85 < x.std() / sd < 1.15


def test_hot_rows_are_spread(spark):
    d = spark.range(40_000).select(F.when(F.col("id") >= 20_000, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_documents(d, 8)
    r = got.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("hot"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect()
    assert len(r) == 8 and all(x["n"] == x["d"] == 5000 and (x["lo"], x["hi"]) == (0, 4999) and 2300 < x["hot"] < 2700 for x in r)


# 5: urls


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in url_cascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "HTTP://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://x.net/de/9", "https://example.net/de/81", "http://com/en/", "http://xcom/en/",
        "http://a.org/es/", "http://org/es", "http://a.b.c.com?x=/en/", "http://a.com#/en/", "http://a.com/en/\nb", "x://y://com/en/", "http://ÉX.com/en/", "http://.com/en/1", "http://com./en/",
        "http://" + "a." * 20_000 + "com/en/7", "http://" + "b" * 300_000 + ".example.com/en/7/" + "c" * 300_000, "http://example..com/en/7",
    ] + ["http://a.com/en/1"] * 3
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.judge_urls(clash(pages)).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert url_cascade.judge_urls(pages.where("false")).count() == 0
    assert url_cascade.judge_urls(pages, rules=()).where("verdict <> 'allow'").count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    listed = universe.where("k like '%7'")
    levels = url_cascade.build_cascade(listed, universe)
    assert len(levels) > 1
    wrong = universe.where(url_cascade.member(levels, F.col("k")) != F.col("k").like("%7"))
    assert wrong.count() == 0
    plan = universe.select(url_cascade.member(levels, F.col("k")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(split(" not in plan and "element_at([" in plan  # filters are literals


# 6: licences


def base_places(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses(docs_of):
    notices = [
        "x Released under the MIT License. y", "Licensed under CC BY-NC 4.0.", "cc by cc by cc-by", "MIT mit-license MIT_License MIT\x80License", "the Apache\nLicense, Version 2.0 " * 3,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following", "license software permitted granted notice copy",
        "This work is licensed under the GNU General Public License, version 3.",
    ]
    d = docs_of(AWKWARD + notices + texts(50))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(clash(d)).collect()}
    for r in d.collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == base_places(r["text"])
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    labels = {i: got[len(AWKWARD) + i]["labels"] for i in range(len(notices))}
    assert labels[0] == "mit" and labels[1] == "cc-by,cc-by-nc" and labels[5] == "mit" and labels[6] == "bsd" and labels[7] == "" and labels[8] == "gpl"
    assert got[len(AWKWARD) + 8]["score"] == 1.0 and all(got[len(AWKWARD) + len(notices) + i]["labels"] == "" for i in range(50))
    assert licenses.scan_licenses(d.where("false")).count() == 0


def test_every_template_finds_itself():
    index = licenses.build_index({}, 0)
    for label, notice, _ in licenses.TEMPLATES:
        got = licenses.scan(f"some words {notice} and more".encode(), index)
        assert label in got[5].split(",") and got[6] == 1.0


@pytest.mark.parametrize("frequent", [(), ("license", "licensed", "under", "the", "of", "is", "this", "and", "in", "to", "cc", "by", "nc", "4", "0")])
def test_a_file_of_all_notices_keeps_all_labels(frequent):
    index = licenses.build_index({w.encode(): 900 for w in frequent}, 1000)
    every = {label for label, _, _ in licenses.TEMPLATES}
    notices = " filler ".join(notice for _, notice, _ in licenses.TEMPLATES)
    assert set(licenses.scan(notices.encode(), index)[5].split(",")) == every
    rare_words = " ".join(sorted(w.decode() for w in index.postings))
    long = f"{rare_words} " * 50
    for label, notice, _ in licenses.TEMPLATES:
        assert label in licenses.scan(f"{long} gap {notice} gap {long}".encode(), index)[5].split(",")


def slow_labels(text, index):
    """Every template at every place of the text, by the definition."""
    words = licenses.words_of((text or "").encode())
    out = set()
    for t, (label, notice, mandatory) in enumerate(index.templates):
        own = notice.encode().split()
        posted = {}
        for w, where in index.postings.items():
            at = [p for u, p in where if u == t]
            if at:
                posted[w] = at
        need = max(2, math.ceil(0.6 * len(posted)))
        for start in range(-len(own), len(words)):
            votes = sum(any(0 <= start + p < len(words) and words[start + p] == w for p in at) for w, at in posted.items())
            if votes < need:
                continue
            fine = True
            for phrase in mandatory:
                parts = phrase.encode().split()
                own_at = start + notice[: notice.index(phrase)].count(" ")
                fine &= any(0 <= a and words[a : a + len(parts)] == parts for a in range(own_at - licenses.SLACK, own_at + licenses.SLACK + 1))
            if fine:
                out.add(label)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_method_labels_equal_brute_force(seed):
    r = random.Random(seed)
    index = licenses.build_index({w: r.randrange(1000) for w in licenses.template_words()}, 1000)
    for _ in range(12):
        parts = []
        for _ in range(r.randint(1, 4)):
            w = r.choice(licenses.TEMPLATES)[1].split()
            for _ in range(r.choice([0, 0, 1, 2, 4])):  # damaged notices
                i = r.randrange(len(w))
                w[i : i + r.randint(0, 2)] = r.choice([[], ["other"], ["license"], w[:2]])
            parts += [*w[: r.choice([len(w), len(w), len(w) // 2])], *r.choices(["the", "license", "software", "x", "under"], k=r.randint(0, 5))]
        text = " ".join(parts)
        base = {label for phrase, label in licenses.BASE if f" {phrase} " in f" {text} "}
        got = licenses.scan(text.encode(), index)
        assert set(filter(None, got[5].split(","))) == base | slow_labels(text, index)


# 7: simhash


def slow_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bucket", [512, 2])
def test_simhash(docs_of, bucket):
    base = " ".join(texts(3, 9))
    near = [base + f" end{i}" for i in range(25)]
    d = docs_of(AWKWARD + texts(60) + near + [base, base])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(clash(d), bucket).collect()}
    fp = {r["doc_id"]: slow_fingerprint(r["text"]) for r in d.collect()}
    edges = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    want = components_of(fp, edges)
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert simhash.simhash_components(d.where("false")).count() == 0


@pytest.mark.parametrize("bucket", [512, 3])
def test_links_of_planted_fingerprints(spark, bucket):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for f in list(fps):
        fps |= {f ^ 1 << r.randrange(64) for _ in range(3)} | {f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for _ in range(3)} | {f ^ 0b111 << r.randrange(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(min(a, b), max(a, b)) for a, b in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (7, 8), (8, 7)]
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(edges + [(None, 1)], "u long, v long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == components_of({n for e in real for n in e}, real)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 8: WARC


def test_warc_round_trip(spark):
    htmls = [None, "", "<p>a</p>", "<p>a</p>", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "é" * 5000, "<p>a</p>", "x", "x"]
    ids = [9, 3, 8, 2, 4, 5, 7, 6, None]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nInjected: 1", h) for i, h in zip(ids, htmls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(clash(pages), archive_bytes=300).collect()}
    assert len(got) == len(ids)
    for i, h in zip(ids, htmls):
        same = [j for j, k in zip(ids, htmls) if (k or "") == (h or "") and j is not None]
        first, raw = min(same), (h or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if i == first else ("revisit", first))
    assert warc.round_trip(pages.where("false")).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages, least_bytes=5).collect()}
    assert small[9] == small[3] == "response" and small[8] == "revisit"


def test_lost_pages_raise_and_gaps_are_logged(spark, tmp_path, caplog):
    r = random.Random(1)
    long = "".join(r.choices("abcdefgh <>", k=3_000_000))
    pages = spark.createDataFrame([(f"p {i}+%\n", "u", long if i == 3 else f"page {i}" * 50) for i in range(20)] + [("", "u", "empty id"), (None, "u", "no id")], "page_id string, url string, html string")
    archives = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w", archive_bytes=10_000)
    back = {r["page_id"]: r for r in warc.pages_of(archives, f"file://{tmp_path}/w", "string").collect()}
    assert set(back) == {f"p {i}+%\n" for i in range(20)} | {"", None}
    assert back["p 3+%\n"]["payload_bytes"] == 3_000_000 and back["p 3+%\n"]["payload_digest"] == warc.digest32(long.encode())
    damaged = min((tmp_path / "w").glob("*.warc.gz"), key=lambda p: p.stat().st_size)
    raw = bytearray(damaged.read_bytes())
    raw[len(raw) // 2] ^= 255
    damaged.write_bytes(bytes(raw))
    (tmp_path / "w" / f".{damaged.name}.crc").unlink(missing_ok=True)
    with caplog.at_level("WARNING"), pytest.raises(warc.Lost, match="1 gaps"):
        warc.pages_of(archives, f"file://{tmp_path}/w", "string")
    assert damaged.name in caplog.text and "quarantined" in caplog.text


def archive(packed):
    return [warc.encode("response", {"X-Page-Id": str(i)}, f"body {i} ".encode() * 40, packed) for i in range(12)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = archive(packed)
    whole = list(warc.salvage(b"".join(parts)))
    assert [r.headers["x-page-id"] for r in whole] == [str(i) for i in range(12)] and all(isinstance(r, warc.Record) for r in whole)
    parts[2] = bytes(b ^ 0x5A for b in parts[2])  # unreadable
    parts[5] = parts[5][: len(parts[5]) // 2]  # cut short
    parts[8] = b"garbage \x1f\x8b\x08 WARC/1.1\r\n more" + parts[8]
    damaged = b"".join(parts)
    got = list(warc.salvage(damaged))
    records, gaps = [x for x in got if isinstance(x, warc.Record)], [x for x in got if isinstance(x, warc.Gap)]
    kept = {int(r.headers["x-page-id"]) for r in records}
    assert kept >= set(range(12)) - {2, 5} and not kept & {2, 5} and len(gaps) == 3
    spans = sorted({(r.offset, r.offset + r.length) for r in records} | {(g.start, g.end) for g in gaps})
    assert spans[0][0] == 0 and spans[-1][1] == len(damaged) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(g.reason for g in gaps)
    assert list(warc.salvage(b"")) == [] and [type(x) for x in warc.salvage(b"nothing here")] == [warc.Gap]


@pytest.mark.parametrize("bad", [0, 2, 4])
def test_salvage_inside_a_member(bad):
    bare = [warc.encode("response", {"X-Page-Id": str(i)}, b"block %d" % i * 9, packed=False) for i in range(5)]
    size = len(b"block 0" * 9)
    for old, new in ((b"block", b"blick"), (b"Content-Length: %d" % size, b"Content-Length: 99999")):
        parts = [x.replace(old, new) if i == bad else x for i, x in enumerate(bare)]
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        one = z.compress(b"".join(parts)) + z.flush()
        got = list(warc.salvage(one + warc.encode("response", {"X-Page-Id": "5"}, b"after")))
        assert [x.headers["x-page-id"] for x in got if isinstance(x, warc.Record)] == [str(i) for i in range(6) if i != bad]
        gaps = [x for x in got if isinstance(x, warc.Gap)]
        start = sum(map(len, parts[:bad]))
        assert [(x.start, x.end) for x in gaps] == [(0, len(one))] and f"bytes {start} to {start + len(parts[bad])} " in gaps[0].reason
        assert isinstance(got[bad], warc.Gap)


def test_a_flipped_bit_is_never_returned():
    part = archive(False)[3]
    for at in range(len(part) - 60, len(part) - 4):
        bad = part[:at] + bytes([part[at] ^ 1]) + part[at + 1 :]
        assert all(isinstance(x, warc.Gap) for x in warc.salvage(bad))


# 9: media


def test_gear_equals_the_rolling_form():
    data = bytes(random.Random(2).randrange(256) for _ in range(5000))
    h, want = 0, []
    for b in data:
        h = (h * 2 + int(media.GEAR[b])) % 2**32
        want.append(h)
    assert media.border_hashes(data).tolist() == want


def test_cuts_follow_content(monkeypatch):
    r = random.Random(4)
    data = bytes(r.randrange(256) for _ in range(300_000))
    ends = media.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    sizes = np.diff([0, *ends])
    assert (sizes[:-1] >= media.LEAST).all() and sizes.max() <= media.MOST
    shifted = {data[a:e] for a, e in zip([0, *ends], ends)} & {(b"xyz" + data)[a:e] for a, e in zip([0, *media.cuts(b"xyz" + data)], media.cuts(b"xyz" + data))}
    assert len(shifted) >= len(ends) - 3
    whole = media.borders(data)
    monkeypatch.setattr(media, "BLOCK", 1000)
    assert (media.borders(data) == whole).all()
    assert media.cuts(b"") == [0] and media.cuts(b"a" * media.LEAST) == [media.LEAST]


def test_media(docs_of):
    shared = " ".join(texts(60, 7))
    d = docs_of(AWKWARD + [shared + " one", shared + " two", shared + " one", "x" * 576, "x" * 577] + texts(40))
    got = {r["doc_id"]: r for r in media.media_columns(clash(d), pack_bytes=5000).collect()}
    assert len(got) == d.count()
    for r in d.collect():
        raw, g = (r["text"] or "").encode(), got[r["doc_id"]]
        p = media.payload_of(raw)
        assert len(p) % 576 == 0 and len(p) - len(raw) < 577 and p[: len(raw)] == raw and set(p[len(raw) :]) <= {255}
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest())
        assert (g["tail_crc32"], g["media_bytes"]) == (zlib.crc32(p[-32:]), len(p) + 44)
        assert g["media_sha256"] == hashlib.sha256(media.to_wav(p)).hexdigest() and g["feature"] == media.features(p)
    assert media.media_columns(d.where("false")).count() == 0


def test_shared_chunks_have_one_address_and_damage_raises(spark, docs_of, tmp_path):
    shared = " ".join(texts(900, 8))
    d = docs_of([shared + " one", shared + " two"]).repartition(2)
    folder = f"file://{tmp_path}/packs"
    lists = media.resolve(media.store(d, folder)).collect()
    a, b = ([(c["name"], c["offset"]) for c in r["chunks"]] for r in lists)
    assert len(set(a) & set(b)) >= len(a) - 2 >= 2
    pack = max((tmp_path / "packs").iterdir(), key=lambda p: p.stat().st_size)
    name = next(n for n, _ in a)
    raw = bytearray((tmp_path / "packs" / name).read_bytes())
    raw[-20] ^= 1
    (tmp_path / "packs" / name).write_bytes(bytes(raw))
    with pytest.raises(Exception):
        media.rebuild(media.resolve(media.store(d, folder)).union(spark.createDataFrame(lists, media.resolve(media.store(d, folder)).schema)), folder).collect()
    assert pack.exists()


# 10: vectors


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    v = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.12, base[:5] * 3, base[:3]]).tolist()
    rows = [(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] + [1.0] * 15, 0), (904, [float("inf")] + [1.0] * 15, 0), (905, [None] + [1.0] * 15, 0), (906, [1.0, 2.0], 0), (907, [1e300] * 16, 0), (908, [1e-300] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.linked_vectors(clash(df.drop("label")).withColumn("label", F.lit(0)), block=16).collect()}
    unit = {i: np.array(r) / np.abs(r).max() for i, r, _ in rows if r and len(r) == 16 and None not in r and np.isfinite(r).all() and any(r)}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.95]
    comp = components_of([r[0] for r in rows], links)
    for i, _, _ in rows:
        assert got[i] == (sum(i in e for e in links), comp[i], comp[i] == i)
    assert embed_dedup.linked_vectors(df.where("false")).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(2)
    a, b = (embed_dedup.normalise(rng.normal(size=(200, 64))) for _ in range(2))
    qa, sa, ea = embed_dedup.quantise(a)
    qb, sb, eb = embed_dedup.quantise(b)
    near = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb
    assert (np.abs(near - a @ b.T) <= eb + ea[:, None] * (1 + eb) + 1e-12).all()


# 4: packing


def test_packing(docs_of):
    encoder = tokens.encoder(packing.VOCABULARY)
    d = docs_of(AWKWARD + texts(300) + ["word " * 2047, "word " * 2048])
    got = packing.pack_documents(clash(d)).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for r in d.collect():
        ids = encoder.whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[r["doc_id"]], key=lambda p: p["piece"])
        cut = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        assert [(p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces] == [(i, 2048 * i, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, c in enumerate(cut)]
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(by_seq) <= 1.02 * total / 2048 + 1
    assert packing.pack_documents(d.where("false")).count() == 0


def test_token_cache_equals_the_tokenizer():
    e = tokens.encoder(packing.VOCABULARY)
    for t in ["Don't STOP, it's 12,345 — naïve ÀÉ ß!", "a\u00a0b", "İstanbul ı ſ", "x" * 500, "tab\tnew\r\nline", "日本 text", "<|endoftext|> hi", "'s 'S re'LL", "½²³ 9a9", "e\u0301 \u2028 z"]:
        assert e.ids(t) == np.array(e.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_grouping_reaches_the_bound():
    r = random.Random(3)
    lengths = [min(2048, max(1, int(r.lognormvariate(6, 1.3)))) for _ in range(8000)]
    hist = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(hist)
    assert sum(c for c, _ in runs) == -(-sum(lengths) // 2048)
    placed = {}
    for count, content in runs:
        for n, k in content:
            placed[n] = placed.get(n, 0) + count * k
    assert placed == hist


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece(seed):
    r = random.Random(seed)
    hist = {n: r.randint(1, 40) for n in r.sample(range(1, 101), 30)} | {100: 7}
    runs = packing.plan(hist, 100, groups=8)
    placed = {}
    for count, content in runs:
        assert count > 0 and sum(n * k for n, k in content) <= 100
        for n, k in content:
            placed[n] = placed.get(n, 0) + count * k
    assert placed == hist
    lower = -(-sum(n * c for n, c in hist.items()) // 100)
    assert sum(c for c, _ in runs) <= 1.15 * lower + 1


# 1: quality


def model_of(train, base, order=4):
    """Interpolated modified Kneser-Ney over the symbols, straight from the counts; ``base`` before any is counted."""
    from collections import Counter, defaultdict
    from functools import lru_cache

    counts = {order: Counter()}
    for s in train:
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, after = {}, defaultdict(dict)
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
        discounts[k] = [min(max(i - (i + 1) * y * (n[i] / n[i - 1] if n[i - 1] else 0.0), 0.1), i - 0.1) for i in (1, 2, 3)]
        for g, v in c.items():
            after[g[:-1]][g] = v

    @lru_cache(None)
    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else base
        inside = after[g[:-1]]
        t = sum(inside.values())
        if not t:
            return lower
        d = discounts[k]
        cut = {h: d[min(v, 3) - 1] for h, v in inside.items()}
        return (max(0, inside.get(g, 0) - cut.get(g, 0)) + sum(cut.values()) * lower) / t

    return p


def symbols_of(text, letters):
    return [0, 0, 0] + [letters.index(c) + 2 if c in letters else 1 for c in text]


def nll_of(text, p, letters):
    s = symbols_of(text, letters)
    return -sum(np.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3))


def test_keys_run_over_borders(monkeypatch):
    letters = ["a", "b", "語", "😀"]
    text = "ab語x😀" * 30
    monkeypatch.setattr(kneser_ney, "RUN", 7)
    got = np.concatenate(list(kneser_ney.keys(text, kneser_ney.lookup(letters)))).view(np.uint64).tolist()
    s = symbols_of(text, letters)
    assert got == [s[i] << 48 | s[i + 1] << 32 | s[i + 2] << 16 | s[i + 3] for i in range(len(text))]
    assert list(kneser_ney.keys("", kneser_ney.lookup(letters))) == []


def test_hash_tables(monkeypatch):
    rng = np.random.default_rng(1)
    k = np.unique(rng.integers(1, 2**62, 5000))
    v = rng.normal(size=len(k))
    probes = kneser_ney.Probes(k, v)
    assert len(probes.rest) < len(k)
    at = rng.integers(0, len(k), 20_000)
    assert probes.total(k[at]) == pytest.approx(v[at].sum())
    with pytest.raises(KeyError):
        probes.total(np.array([12345]))
    monkeypatch.setattr(kneser_ney, "RUN", 100)
    seen = kneser_ney.Distinct(bits=6)
    for part in np.array_split(k[at], 37):
        seen.put(part)
    assert seen.all().tolist() == np.unique(k[at]).tolist()


def test_kneser_ney_equals_brute_force(docs_of):
    train = texts(12, 3) + ["日本語の文章 река 😀" * 3]
    model = kneser_ney.train(docs_of(train).select("lang", "text"))
    letters = model.letters["en"]
    assert set(letters) == set("".join(train))
    p = model_of([symbols_of(t, letters) for t in train], 1 / (len(letters) + 1))
    probe = docs_of([*texts(3, 4), "ZZZ unseen — é 本語 😀", None, "", train[0]], ["en"] * 6 + ["xx"])
    got = {r["doc_id"]: (r["n"], r["nll"]) for r in kneser_ney.score(kneser_ney.to_blocks(probe.repartition(3)), model).collect()}
    for r in probe.collect():
        if not r["text"] or r["lang"] != "en":
            assert got[r["doc_id"]] == (len(r["text"] or ""), None)
        else:
            assert got[r["doc_id"]] == (len(r["text"]), pytest.approx(nll_of(r["text"], p, letters), rel=1e-9))


def test_probabilities_sum_to_one(spark, docs_of):
    model = kneser_ney.train(docs_of(texts(5)).select("lang", "text"))
    rows = [("en", ctx << 16 | s, ctx) for ctx in (0, 2, 2 << 32 | 3 << 16 | 4, 7 << 16 | 7, 9 << 32 | 9 << 16 | 9) for s in range(1, len(model.letters["en"]) + 2)]
    wanted = spark.createDataFrame(rows, "lang string, key long, ctx long")
    lp = kneser_ney.log_probabilities(wanted.select("lang", "key"), model).join(wanted, ["lang", "key"])
    sums = lp.groupBy("ctx").agg(F.sum(F.exp("lp")).alias("s")).collect()
    assert len(sums) == 5 and all(r["s"] == pytest.approx(1) for r in sums)


@pytest.mark.parametrize("quantile", [0.99, 0.5])
def test_quality_equals_brute_force(spark, docs_of, quantile):
    r = random.Random(11)
    all_texts = [t[: r.randint(20, 200)] for t in texts(70, 12)] + ["".join(r.choices("#%@xqzj0189", k=60)) for _ in range(8)] + [None, ""]
    langs = ["en", "de"] * 39 + ["en", "de"]
    d = docs_of(all_texts, langs)
    labelled = [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(3)]
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in kneser_ney.classify(d, labels, quantile).collect()}
    h = {x["doc_id"]: x["h"] for x in d.select("doc_id", kneser_ney.draw().alias("h")).collect()}
    for lang in ("en", "de"):
        own = [i for i in range(3, 60) if langs[i] == lang]
        train, held = [i for i in own if h[i] < 2048], [i for i in own if h[i] >= 2048]
        assert train and held
        letters = sorted({c for i in train for c in all_texts[i]})
        p = model_of([symbols_of(all_texts[i], letters) for i in train], 1 / (len(letters) + 1))
        rate = {i: nll_of(all_texts[i], p, letters) / len(all_texts[i]) for i in range(78) if langs[i] == lang}
        steps = sorted(math.ceil(rate[i] / 0.001) for i in held)
        limit = steps[math.ceil(quantile * len(steps)) - 1] * 0.001
        for i in rate:
            assert got[i]["perplexity"] == pytest.approx(math.exp(rate[i]), rel=1e-9) and got[i]["threshold"] == pytest.approx(math.exp(limit))
            assert got[i]["accepted"] == (rate[i] <= limit + 1e-12)
    assert not got[78]["accepted"] and not got[79]["accepted"] and got[78]["perplexity"] is None


def test_quality(spark, docs_of):
    good, bad = texts(300), ["".join(random.Random(i).choices("#%@xqzj0189", k=200)) for i in range(40)]
    d = docs_of(good + bad + [None, "", good[0]], ["en"] * 338 + ["xx", None] + ["en"] * 3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(i, 0, 0) for i in range(300, 320)] + [(2, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser_ney.classify(clash(d), labels).collect()}
    assert sum(got[i]["accepted"] for i in range(1, 300, 2)) >= 145 and not any(got[i]["accepted"] for i in range(300, 338))
    assert got[338]["accepted"] and got[338]["threshold"] is None and got[339]["accepted"] and not got[340]["accepted"] and not got[341]["accepted"]
    assert got[342]["perplexity"] == got[0]["perplexity"]
    assert kneser_ney.classify(d, labels.where("false")).where("accepted").count() == 341
    assert kneser_ney.classify(d.where("false"), labels).count() == 0


def test_quality_trains_on_all_trusted_text(spark, docs_of):
    junk = ["".join(random.Random(i).choices("#%@xqzj0189", k=200)) for i in range(3)]
    first = spark.range(40).orderBy(kneser_ney.draw("id")).first()["id"]
    good = texts(40)
    good[first] = " ".join(good) + " zebra" * 700_000  # over 4 M characters
    d = docs_of(good + texts(6) + junk * 4, ["en"] * 40 + ["aa", "bb", "bb", "cc", "cc", "cc"] + ["en"] * 3 + ["aa"] * 3 + ["bb"] * 3 + ["cc"] * 3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(46)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser_ney.classify(d, labels).collect()}
    assert all(r["threshold"] is not None for r in got.values())
    assert not any(got[i]["accepted"] for i in range(46, 58))
    told = d.where("doc_id < 46")
    cuts = {r["lang"]: (r["upto"], r["since"]) for r in kneser_ney.training_cut(told).collect()}
    drawn = told.select("lang", kneser_ney.draw().alias("h")).collect()
    for lang, (upto, since) in cuts.items():
        h = [r["h"] for r in drawn if r["lang"] == lang]
        assert any(x < upto for x in h) and any(x >= since for x in h) and (len(set(h)) == 1 or upto == since)



# 2: mixing


def test_mixing_meets_its_targets(spark, docs_of):
    r = random.Random(6)
    pools = {(1, 0): "river stone light hills bird", (0, 0): "buy click offer deal cheap", (1, 1): "vile curse spit stone light", (0, 1): "vile click spam curse deal"}
    kinds = [k for k, n in (((1, 0), 200), ((0, 0), 120), ((1, 1), 60), ((0, 1), 40)) for _ in range(n)]
    d = docs_of([" ".join(r.choices(pools[k].split(), k=r.randint(5, 60))) for k in kinds] + [None, "", "river"])
    labels = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds) if i % 2] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    targets = {"q1t0": 0.7, "q1t1": 0.2, "q0t0": 0.07, "q0t1": 0.03}
    out = mixing.rates(clash(d), labels, targets=targets).collect()
    total = sum(x["n_tokens"] for x in out)
    for name, share in targets.items():
        assert sum(x["rate"] * x["n_tokens"] * x[f"p_{name}"] for x in out) / total == pytest.approx(share, abs=0.01)
    assert all(x["rate"] >= 0 and x["copies"] in (int(x["rate"]), int(x["rate"]) + 1) for x in out) and len(out) == d.count()
    right = [max(targets, key=lambda n: x[f"p_{n}"]) == f"q{kinds[x['doc_id']][0]}t{kinds[x['doc_id']][1]}" for x in out if x["doc_id"] < 420 and x["doc_id"] % 2 == 0]
    assert sum(right) / len(right) > 0.9  # held out
    again = mixing.resample(d, labels, targets=targets)
    assert again.columns == d.columns and again.count() == sum(x["copies"] for x in out)
    assert mixing.rates(d, labels.where("false")).count() == d.count() and mixing.rates(d.where("false"), labels).count() == 0


def bag_of(text):
    import re

    t = text or ""
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if x]
    share = [sum(c in kind for c in t) / max(1, len(t)) for kind in (mixing.UPPER, mixing.MARKS)]
    bins = lambda name, x, edges: f" {name}{sum(x > e for e in edges)}"
    shape = [
        bins("capitals", share[0], [0.05, 0.15, 0.4]), bins("marks", share[1], [0.02, 0.05, 0.1, 0.2]),
        bins("distinct", len(set(w)) / max(1, len(w)), [0.05, 0.15, 0.3, 0.45, 0.6]) + bins("size", np.log2(len(w) + 1), [3, 5, 7, 9]),
    ]
    return len(w), set(w) | set(shape)


def test_posteriors_equal_brute_force(spark, docs_of):
    r = random.Random(9)
    kinds = [r.choice([(1, 0), (0, 0), (0, 1)]) for _ in range(120)]
    own = {(1, 0): "river stone light", (0, 0): "buy! click OFFER", (0, 1): "vile click CURSE"}
    all_texts = [" ".join(r.choices((own[k] + " the of and").split(), k=r.randint(1, 30))) for k in kinds] + [None, "", "\n", "a b\n", " a\tb ", "Ünïcode ÉTÉ!"]
    d = docs_of(all_texts)
    labels = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "doc_id long, quality int, toxic int")
    sample = mixing.labelled_bags(d, labels, 6000)
    base, present = mixing.fit(sample, 20)
    names = [f"q{q}t{t}" for q, t in kinds]
    bags = [bag_of(t) for t in all_texts]
    for x in base:
        assert base[x] == pytest.approx(math.log(names.count(x) / 120))
    for f, lift in present.items():
        every = (sum(f in bags[i][1] for i in range(120)) + 1) / 122
        for x in base:
            inside = sum(f in bags[i][1] for i in range(120) if names[i] == x)
            assert lift[x] == pytest.approx(math.log((inside + every) / (names.count(x) + 1)) - math.log(every))
    domains = sorted(base)
    for row in mixing.posteriors(d, base, present, domains).collect():
        n, bag = bags[row["doc_id"]]
        z = np.array([base[x] + sum(present[f][x] for f in bag if f in present) for x in domains])
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert row["n_tokens"] == n and row["post"] == pytest.approx(want.tolist(), abs=1e-12)


def test_calibration(spark, docs_of):
    r = random.Random(4)
    kinds = [r.choices([(1, 0), (0, 0), (0, 1)], [6, 2, 1])[0] for _ in range(300)]
    words = {(1, 0): "river stone light hill", (0, 0): "buy click offer river", (0, 1): "vile click curse stone"}
    # words that always go together: naive Bayes counts them as so many pieces of evidence
    d = docs_of([" ".join(x + y for y in ("", "s", "es", "ing") for x in r.choices(words[k if r.random() < 0.8 else r.choice(kinds)].split(), k=3)) for k in kinds])
    labels = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "doc_id long, quality int, toxic int")
    sample = mixing.labelled_bags(d, labels, 6000)
    raw = mixing.fit(sample, 40)
    domains, losses = sorted(raw[0]), []
    for model in (raw, mixing.calibrated(sample, *raw)):
        rows = mixing.scored(sample, *model, domains).collect()
        post = np.array([x["post"] for x in rows])
        losses.append(-np.mean([np.log(max(1e-300, p[domains.index(x["domain"])])) for x, p in zip(rows, post)]))
    assert losses[1] < losses[0]
    share = [np.mean([x["domain"] == n for x in rows]) for n in domains]
    assert post.mean(axis=0) == pytest.approx(share, abs=1e-4)
    assert mixing.calibrated(sample, {}, {}) == ({}, {})


def test_solver_equals_a_dense_one(spark):
    rng = np.random.default_rng(3)
    post = rng.dirichlet([0.6, 0.3, 0.3], 50)
    tok = rng.integers(1, 100, 50).astype(float)
    goal, ridge = np.array([0.8, 0.15, 0.05]), 1e-2
    cells = spark.createDataFrame([(float(t), *[float(t * x) for x in p]) for t, p in zip(tok, post)], "tokens double, s0 double, s1 double, s2 double")
    r = np.maximum(0, 1 - post @ np.array(mixing.solve(cells, goal.tolist(), 60, ridge)))
    x, w = np.ones(50), tok / tok.sum()
    for _ in range(200_000):
        x = np.maximum(0, x - 0.5 * (post @ (post.T @ (w * x) - goal) + ridge * (x - 1)))
    assert np.abs(r - x).max() < 1e-3
