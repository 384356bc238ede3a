"""Plain twins of operators that SQL cannot express: loops, counters and one-shot compression."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
import zstandard

from bankspark.llm.language import LEVEL, PIECE, SHORTEST_MATCH, identify_languages, language_dictionaries
from bankspark.llm.licenses import PHRASES, TEMPLATES, license_scan
from bankspark.llm.likelihood import BUCKETS, quality_rules
from bankspark.llm.quotations import link_quotations
from bankspark.llm.weak_labels import BINS, BOUND, classify_quality, count_patterns, fit_labellers, fit_scorer, label_documents
from bankspark.llm.words import shingle, word_hashes


# ---- op3: every quoted unit is looked for in every message of its conversation

SPACES = " \t\n\x0b\f\r"


def plain(text):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip(" ")


def parts(text):
    """[(depth, passage)] of a quoting message."""
    lines = []
    for raw in re.split(r"\r?\n", text):
        marks = re.match(rf"[{SPACES}]*>[>{SPACES}]*", raw)
        lines.append((marks.group().count(">"), raw[marks.end():]) if marks else (0, raw))
    out = []
    for i, (depth, raw) in enumerate(lines):
        deeper = i + 1 < len(lines) and lines[i + 1][0] > depth
        if deeper and re.search(r"(?i)\bwrote:\s*$", raw):
            continue
        if out and out[-1][0] == depth:
            out[-1][1].append(raw)
        else:
            out.append((depth, [raw]))
    return [(d, "\n".join(x)) for d, x in out]


def units(body):
    """{(words, kind)}: 2 for the whole, 1 for a long line, 0 for a short one."""
    lines = [plain(x) for x in body.split("\n")]
    whole = {(plain(body), 2)} if plain(body) else set()
    return whole | {(x, 1 if len(x.split(" ")) >= 4 else 0) for x in lines if x}


def link_plainly(rows):
    written, quoted, own = defaultdict(set), {}, {}
    for conv, turn, _, text in rows:
        if text is None:
            continue
        if any(re.match(rf"[{SPACES}]*>", x) for x in text.split("\n")):
            runs = parts(text)
            quoted[conv, turn, text] = [(d, t) for d, t in runs if d]
            own[conv, turn, text] = "\n".join(t for d, t in runs if not d).strip(SPACES)
            bodies = [t for d, t in runs if not d] + [own[conv, turn, text]]
        else:
            bodies = [text]
        for b in bodies:
            written[conv, turn] |= units(b)

    def first(conv, words, long):
        turns = [t for (c, t), us in written.items() if c == conv and None not in (c, t)
                 and any(w == words and (k > 0) == long for w, k in us)]
        return min(turns, default=None)

    reply = {}
    for (conv, turn, _), passages in quoted.items():
        if conv is None or turn is None:
            continue
        for depth in sorted({d for d, _ in passages}):
            matches = set()
            for words, kind in set().union(*[units(t) for d, t in passages if d == depth]):
                by_long, by_short = first(conv, words, True), first(conv, words, False)
                if kind:
                    matches.add((words, by_long, kind))
                else:
                    matches.add((words, min([t for t in (by_long, by_short) if t is not None], default=None), 0))
                if kind == 2:
                    matches.add((words, by_short, 0))
            per = defaultdict(list)
            for _, origin, kind in matches:
                if origin is not None and origin < turn:
                    per[origin].append(kind)
            if per:
                best = max((2 in k, sum(x > 0 for x in k), k.count(0), origin) for origin, k in per.items())
                reply[conv, turn] = min(reply.get((conv, turn), best[3]), best[3])
                break
    out = []
    for conv, turn, role, text in rows:
        root, steps = turn, 0
        while (conv, root) in reply:
            root, steps = reply[conv, root], steps + 1
        n = len(quoted.get((conv, turn, text), []))
        out.append((conv, turn, role, own[conv, turn, text] if n else text, n, reply.get((conv, turn)), root, steps))
    return sorted(out, key=repr)


def test_quotations_against_all_pairs(spark):
    draw = random.Random(11)
    lines = ["yes please", "Thanks!", "ok", "", "  ", "On Monday Ann wrote:", "...", "Ünïcode words stand here too"]
    lines += [f"line number {k} has some words" for k in range(6)]

    def some():
        return [draw.choice(lines) for _ in range(draw.randint(1, 3))]

    rows = []
    for conv in range(40):
        for turn in range(draw.randint(3, 9)):
            body = some()
            for _ in range(draw.randint(0, 3)):
                mark = draw.choice([">", "> ", ">> ", "> > ", " >", ">>> "])
                body += [mark + x for x in some()] + some() * draw.randint(0, 1)
            rows.append((draw.choice([conv] * 30 + [None]), draw.choice([turn] * 30 + [None, 1]), "user", draw.choice(["\n", "\n", "\r\n"]).join(body)))
    rows += rows[:5] + [(1, 2, "user", None), (1, 2, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in link_quotations(frame).collect()), key=repr)
    want = link_plainly(rows)
    assert sum(r[5] is not None for r in want) > 50 and max(r[7] for r in want) > 2
    assert got == want


# ---- op8: dictionaries and sizes by hand

def letters(text):
    return " ".join("".join(c if ord(c) >= 128 or "a" <= c <= "z" else " " for c in text.lower()).split(" ")).encode()


def hashed(doc_id):
    seed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", 17), seed=seed)
    return h - 2**64 if h >= 2**63 else h


def test_languages_by_compressed_size(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    dictionaries = language_dictionaries(docs, sample=16, dictionary_bytes=20000)

    slots, n = {}, Counter()
    for d, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            key = lang, hashed(d) % 16
            slots[key] = min(slots.get(key, (hashed(d), d)), (hashed(d), d))
            n[lang] += 1
    texts = {d: t for d, t, _ in rows}
    want = []
    for lang in sorted(n, key=lambda x: (-n[x], x)):
        own = sorted((re.sub(rb" +", b" ", letters(texts[d])).strip(b" ") for _, d in sorted((x, d) for (k, _), (x, d) in slots.items() if k == lang)), key=len)
        left, content = 20000, []
        for k, text in enumerate(own):
            content.append(text[: left // (len(own) - k)])
            left -= len(content[-1])
        want.append((lang, b"\n".join(content)))
    even = max(8192, min(len(c) for _, c in want))
    assert [(x, sorted(c.split(b"\n")[1:])) for x, c in dictionaries] == [(x, sorted(c[-even:].split(b"\n")[1:])) for x, c in want]

    def size(data, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=PIECE, dict_size=len(content), min_match=SHORTEST_MATCH,
            write_content_size=False, write_dict_id=False, write_checksum=False)
        d.precompute_compress(compression_params=p)
        c = zstandard.ZstdCompressor(dict_data=d, compression_params=p)
        return sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE))

    got = {r.doc_id: r for r in identify_languages(docs, dictionaries, 0.02).collect()}
    assert len(got) == len(rows)
    for d, text, _ in rows[::5]:
        if text is None or not regex.search(r"\p{L}", text):
            assert (got[d].lang_pred, got[d].score, got[d].rejected) == ("und", 0.0, True)
            continue
        data = re.sub(rb" +", b" ", letters(text)).strip(b" ")
        sizes = sorted((size(data, content), k) for k, (_, content) in enumerate(dictionaries))
        score = 1 - sizes[0][0] / sizes[1][0]
        assert got[d].lang_pred == dictionaries[sizes[0][1]][0] and got[d].score == pytest.approx(score, abs=1e-12)
        assert got[d].rejected == (score < 0.02)


# ---- op7: multinomials by counters, the threshold by trying all

def grams(text):
    words, _, _ = word_hashes(pa.array([text], pa.string()), lower=False)
    both = list(words) + (list(shingle(words, 2)) if len(words) > 1 else [])
    return [int(x) % BUCKETS for x in both]


def test_likelihood_ratios_and_threshold(spark, folder):
    sf = folder.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality in (0, 1):
            known[r.doc_id] = min(known.get(r.doc_id, 1), r.quality)
    assert 0 < len(known) < 20000
    own = {r.doc_id: grams(r.text) for r in docs.collect()}
    raw, target = Counter(), Counter()
    for d, found in own.items():
        raw.update(found)
        if known.get(d) == 1:
            target.update(found)
    all_raw, all_target = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    ratio = {b: np.log((target[b] + 1) / all_target) - np.log((raw[b] + 1) / all_raw) for b in raw}
    llr = {d: float(np.mean([ratio[b] for b in found])) if found else 0.0 for d, found in own.items()}
    good = np.array([np.floor(min(max(llr[d], -10), 10) * 1000) for d, k in known.items() if k == 1 and d in llr])
    bad = np.array([np.floor(min(max(llr[d], -10), 10) * 1000) for d, k in known.items() if k == 0 and d in llr])
    gains = {t: (bad < t).mean() - (good < t).mean() for t in range(-10000, 10002) if (good < t).mean() <= 1 - 0.99}
    top = max(gains.values())
    threshold = min(t for t, g in gains.items() if g >= top - 1e-12) / 1000
    rows = quality_rules(docs, labels).collect()
    assert len(rows) == len(own)
    for r in rows:
        assert r.llr == pytest.approx(llr[r.doc_id], abs=1e-9)
        if abs(r.llr - threshold) > 1e-9:
            assert r.kept == (not r.base_failed and llr[r.doc_id] >= threshold)
    assert len({r.kept for r in rows if not r.base_failed}) == 2


# ---- op2: votes by regular expressions, expectation maximisation over documents, weights by loops

def vote(value, good, bad):
    return 1 if good and good[0] <= value <= good[1] else 0 if not bad[0] <= value <= bad[1] else 2


def cast_plainly(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if not n:
        return [0] * 8
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    times = Counter(triples)
    repeated = len({i + k for i, x in enumerate(triples) if times[x] > 1 for k in range(3)})
    clean = sum(bool(re.fullmatch(rb"[A-Za-z\x80-\xff]+[.,;:!?]?", w.encode())) for w in words)
    ends = len(re.findall(r"[.!?](?=[\x20\x09-\x0D]|\Z)", text))
    letters_ = max(1, len(re.findall("[A-Za-z]", text)))
    inf = float("inf")
    return [
        vote(len(re.findall(r"[#*$%&|<>]", text)) / n, None, (0, 0.25)),
        vote(len(re.findall("[A-Z]", text)) / letters_, None, (0, 0.4)),
        vote(repeated / n, None, (0, 0.4)),
        vote(clean / n, (0.9, 1), (0.6, 1)),
        vote(ends / n, (0.02, 0.3), (0.005, 0.5)),
        vote(n, (60, inf), (20, inf)),
        vote(text.count(" | ") / n, None, (0, 0.1)),
        vote(len(set(words)) / n**0.8, (0.7, inf), (0.35, inf)),
    ]


def test_weak_labels_document_by_document(spark, folder):
    sf = folder.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = list(texts)
    cast = np.array([cast_plainly(texts[d]) for d in ids])

    good, bad = (cast == 1).sum(axis=1), (cast == 0).sum(axis=1)
    posterior = (good + 1) / (good + bad + 2)
    for _ in range(400):
        odds = np.full(len(ids), np.log((posterior.sum() + 1) / ((1 - posterior).sum() + 1)))
        for k in range(8):
            chance = {}
            for v in range(3):
                at = cast[:, k] == v
                chance[v] = posterior[at].sum() + 1, (1 - posterior[at]).sum() + 1
            yes, no = (sum(chance[v][i] for v in range(3)) for i in (0, 1))
            odds += np.array([np.log(chance[v][0] / yes) - np.log(chance[v][1] / no) for v in range(3)])[cast[:, k]]
        posterior = 1 / (1 + np.exp(-odds))
    soft = dict(zip(ids, posterior, strict=True))

    got = {r.doc_id: r for r in classify_quality(docs).collect()}
    assert max(abs(got[d].posterior - soft[d]) for d in ids) < 1e-6

    labelled = label_documents(docs)
    weight, slope, intercept = fit_scorer(labelled, fit_labellers(count_patterns(labelled))[0])
    buckets, all_good, every = {}, Counter(), Counter()
    for d in ids:
        words, _, _ = word_hashes(pa.array([texts[d]], pa.string()), lower=False)
        buckets[d] = [int(w) % BUCKETS for w in set(words.tolist())]
        for b in buckets[d]:
            every[b] += 1
            all_good[b] += round(soft[d], 3)
    sum_good = sum(all_good.values())
    sum_bad = sum(every.values()) - sum_good
    for b in list(every)[::7]:
        odds = np.log((all_good[b] + 1) / (sum_good + BUCKETS)) - np.log((every[b] - all_good[b] + 1) / (sum_bad + BUCKETS))
        assert weight[b] == pytest.approx(odds, abs=1e-3)
    raw = {d: float(np.mean([weight[b] for b in buckets[d]])) if buckets[d] else -BOUND for d in ids}
    for d in ids:
        score = 1 / (1 + np.exp(-np.clip(slope * raw[d] + intercept, -30, 30)))
        assert got[d].score == pytest.approx(score, abs=1e-9)
        if abs(got[d].posterior + score - 1) > 1e-9:
            assert got[d].kept == (got[d].posterior + score >= 1)
    # the slope and intercept are where the logistic likelihood of the binned scores is level
    x = np.array([(round((np.clip(raw[d], -BOUND, BOUND) / BOUND + 1) / 2 * BINS) / BINS * 2 - 1) * BOUND for d in ids])
    p = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
    y = np.array([round(soft[d], 3) for d in ids])
    assert abs(((y - p) * x).sum() - 0.1 * (slope - 1)) < 0.01 * len(ids) and abs((y - p).sum() - 0.1 * intercept) < 0.01 * len(ids)


# ---- op5: templates as regular expressions over spaced words

def spaced_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return " " + "".join(w + " " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower))


def expression(markup):
    out = "(?<= )"
    for part in re.findall(r"\[\[|\]\]|<<\d+>>|[^\[\]<>]+", markup):
        if part.startswith("<<"):
            out += "(?:[^ ]+ ){0,%s}" % part[2:-2]
        else:
            out += {"[[": "(?:", "]]": ")?"}.get(part) or re.escape(spaced_words(part)[1:]).replace(r"\ ", " ")
    return regex.compile(out)


def test_templates_against_regular_expressions(spark, folder):
    draw = random.Random(5)
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.collect()]
    for markup in TEMPLATES.values():
        tokens = re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", markup)
        for _ in range(60):  # regions kept or left out, then a few words lost, doubled or put in
            words, keep = [], [True]
            for t in tokens:
                if t == "[[":
                    keep.append(keep[-1] and draw.random() < 0.5)
                elif t == "]]":
                    keep.pop()
                elif keep[-1]:
                    words += ["filler"] * draw.randint(0, int(t[2:-2]) + 1) if t.startswith("<<") else [t]
            for _ in range(draw.choice([0, 0, 1, 2])):
                at = draw.randrange(len(words))
                words[at : at + 1] = draw.choice([[], [words[at]] * 2, [words[at], "mit"], ["(" + words[at].upper() + ")"]])
            texts.append(" ".join(["some", "license"] * draw.randint(0, 9) + words + ["all"] * draw.randint(0, 2)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = {name: expression(markup) for name, markup in TEMPLATES.items()}
    seen = Counter()
    for r in license_scan(frame).collect():
        text = spaced_words(texts[r.doc_id])
        own = {name for name, e in templates.items() if e.search(text)}
        base = {label for phrase, label in PHRASES.items() if f" {phrase} " in text}
        assert r.labels == ",".join(sorted(own | base)) and r.score == (1.0 if own else 0.5 if base else 0.0)
        seen.update(own or ["none"])
    assert set(seen) == {*TEMPLATES, "none"} and min(seen.values()) >= 10
