import random
import re

import numpy as np

from parlance.llm import spans
from parlance.llm.words import scan
from tests.llm.fixtures import SF, WORDS, awkward, docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = re.compile(r"""[.!?]["')\]]?$|[؟۔…。]$""")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    """The sentences of a text, each a list of word matches: by marks and line breaks; long ones word by word, a piece
    ending where the word's hash (the operator's own) is the least of some twelve in a row, the last one of equals."""
    out, now = [], []
    words = list(WORD.finditer(text))
    for i, m in enumerate(words):
        now.append(m)
        if i + 1 == len(words) or END.search(m.group()) or "\n" in text[m.end() : words[i + 1].start()]:
            if len(now) > 12:
                raw = " ".join(x.group() for x in now).encode()
                h = scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash.tolist()
                ends = {max(k for k in range(a, a + 12) if h[k] == min(h[a : a + 12])) for a in range(len(h) - 11)} | {len(h) - 1}
                a = 0
                for b in sorted(ends):
                    out.append(now[a : b + 1])
                    a = b + 1
            else:
                out.append(now)
            now = []
    return out


def brute(rows, run=spans.RUN):
    """Texts by row, from spans compared by their words in the order of key (null last), text hash, and place."""
    cut = [split(text or "") for _, _, text in rows]
    words = [[tuple(m.group().translate(SMALL) for m in s) for s in own] for own in cut]
    first, texts = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    gone = [set() for _ in rows]
    for i in order:
        own = words[i]
        for p in range(max(1, len(own) - run + 1) if own else 0):
            if first.setdefault(tuple(own[p : p + run]), (i, p)) != (i, p):
                gone[i] |= set(range(p, min(p + run, len(own))))
    for i, (_, _, text) in enumerate(rows):
        out, at = "", 0
        for k, s in enumerate(cut[i]):
            if k in gone[i]:
                if k - 1 not in gone[i]:
                    out += text[at : s[0].start()]
                    opened = s[0].start()
                if k + 1 not in gone[i]:
                    at = cut[i][k + 1][0].start() if k + 1 < len(cut[i]) else len(text)
                    if "\n" in text[s[-1].end() : at] and opened > 0 and text[opened - 1] != "\n":
                        out += "\n"
        texts.append(text if not gone[i] else out + text[at:])
    return texts


def with_hashes(df):
    return [tuple(r) for r in df.selectExpr("doc_id", "xxhash64(text)", "text").collect()]


def same(spark, rows):
    df = docs(spark, [(i, t, "en", "a") for i, t in rows])
    wanted = with_hashes(df)
    got = sorted(((r["doc_id"], r["text"]) for r in spans.deduplicated(df).collect()), key=repr)
    assert got == sorted(((w[0], t) for w, t in zip(wanted, brute(wanted), strict=True)), key=repr)


def test_against_brute_force(spark):
    rows = with_hashes(spark.read.parquet(f"{SF}/documents.parquet"))
    got = dict(spans.query(spark, SF).select("doc_id", "text").collect())
    assert [got[r[0]] for r in rows] == brute(rows)


def test_shared_and_missing_keys(spark):
    """Texts that share a key lose to each other; rows without a key come last, however often they repeat."""
    shared, other = prose(80, 90), prose(81, 90)
    rows = [(1, shared + ". " + prose(82, 30)), (1, shared + ". " + prose(83, 30)), (None, shared), (None, other), (None, other), (None, other), (2, "Hello there. " + other)]
    rows += [(None, prose(84, 50))] * 5 + [(3, prose(85, 50))] * 3 + [(None, None), (None, None), (None, " "), (4, ""), (4, "")]
    same(spark, rows)
    got = [(r["doc_id"], r["text"], r["removed_words"]) for r in spans.deduplicated(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()]
    assert sum(t == prose(84, 50) for _, t, _ in got) == 1 and sum((i, t, n) == (None, "", 50) for i, t, n in got) == 4
    assert sum(t == prose(85, 50) for _, t, _ in got) == 1 and sum(n for i, _, n in got if i == 1) >= 85
    assert any(i == 2 and other in t for i, t, _ in got)


def test_repeated_passage_goes_and_the_rest_stays(spark):
    passage = prose(50, 70)
    rows = [(1, prose(51, 60) + ". " + passage, "en", "a"), (2, prose(52, 63) + "\n" + passage + "\n" + prose(53, 45), "en", "a"), (3, prose(54, 200), "en", "a")]
    got = {r["doc_id"]: r for r in spans.deduplicated(docs(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1] and got[3]["removed_words"] == 0
    assert got[2]["removed_words"] >= 60 and got[2]["text"].startswith(prose(52, 63)) and got[2]["text"].endswith(prose(53, 45))


def test_short_repeated_sentences_and_lines_go(spark):
    short, lines = "Read more. Share this. Log in.", "漢字かな\n仮名交じり\n文章です"
    rows = [(1, prose(71, 60) + ". " + short, "en", "a"), (2, prose(72, 63) + "\n" + short + "\n" + prose(73, 45), "en", "a"), (3, lines, "ja", "a"), (4, prose(74, 40) + "\n" + lines, "ja", "a")]
    got = {r["doc_id"]: r for r in spans.deduplicated(docs(spark, rows)).collect()}
    assert got[1]["removed_words"] == got[3]["removed_words"] == 0
    assert got[2]["text"] == prose(72, 63) + "\n" + prose(73, 45) and got[2]["removed_words"] == 6
    assert got[4]["removed_words"] == 3 and "漢" not in got[4]["text"]


def test_passages_in_mid_sentence(spark):
    """Plain word sequences: passages of 51 to 60 words go, but for a few words at their ends; other words stay."""
    r, rows, much = random.Random(5), [], 400
    plain = lambda n: [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]
    own = {}
    for i in range(much):
        passage = plain(51 + i % 10)
        for key in (i, much + i):
            before, after = plain(r.randrange(3, 40)), plain(r.randrange(3, 40))
            rows.append((key, " ".join(before + passage + after), "en", "a"))
        own[much + i] = before, len(passage), after
    got = {x["doc_id"]: x for x in spans.deduplicated(docs(spark, rows)).collect()}
    assert all(got[i]["removed_words"] == 0 for i in range(much))
    shares = []
    for key, (before, n, after) in own.items():
        text = got[key]["text"].split()
        assert text[: len(before)] == before and text[len(text) - len(after) :] == after
        assert 12 <= got[key]["removed_words"] <= n
        shares.append(got[key]["removed_words"] / n)
    assert sum(shares) / much > 0.75


def test_awkward_rows(spark):
    got = spans.deduplicated(docs(spark)).collect()
    assert len(got) == len(awkward())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[5][0]["text"] is None and by[6][0]["text"] == "" and by[1][0]["text"] == awkward()[0][1]
    assert [r["text"] for r in by[2]] == ["", ""] and by[14][0]["removed_words"] == 120
    assert got[0]["score"] == "mine"


def test_empty_table(spark):
    assert spans.deduplicated(docs(spark, [])).count() == 0
