"""The text operators against plain Python over awkward rows."""

import hashlib
import html
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, chat, exact_dedup, html_text, line_dedup, packing, pii, queries, toxicity

WHITE = " \t\n\x0b\x0c\r"
TEXTS = [
    None, "", " ", "\n", "\n\n", "Hello world", "hello WORLD\n  Footer \n", "é😀 ﬁ Å Ⅷ İ ǅ", "it's we'll I'VE 12345 !!??", "<|endoftext|> x <|startoftext|>y", "a\x1cb\x1dc\x85d e f",
    "x" * 3000, "lorem ipsum dolor " * 400, "ς Σ ΑΣ. ΟΔΟΣ", "﻿bom ​ zero", "a\r\nb\rc", "ＡＢＣ １２３", "\x00\x01", "한국어 텍스트 日本語", "<|im_end|> <\\|x <\\\\|y",
]


def frame(spark, texts, extra="ids string, lang int, size string"):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (3, texts[5], "x", 1, "y"), (None, texts[5], None, None, None)], f"doc_id long, text string, {extra}").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_packing_holds_every_id_once(spark):
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    tokenizer = Tokenizer.from_file(path)
    df = frame(spark, TEXTS)
    pieces = packing.pack(df, path, window=64).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length > 0 and len(p.ids) == 4 * p.length
        docs[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert sum(sum(p.length for p in s) < 64 for s in sequences.values()) <= 1
    said = Counter((r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in df.collect())
    got = Counter()
    for (doc, n), own in docs.items():
        own.sort(key=lambda p: (p.start, p.sequence_id))
        starts = Counter(p.start for p in own)
        if max(starts.values()) > 1:  # rows that repeat
            times = starts[0]
            assert sum(p.length for p in own) == times * n
            seen = {p.start: p for p in own}
            own = [seen[s] for s in sorted(seen)]
            got[doc, b"".join(bytes(p.ids) for p in own)[: 4 * n]] += times
            continue
        got[doc, b"".join(bytes(p.ids) for p in own)] += 1
    assert got == said
    assert packing.pack(empty(spark), path).collect() == []


def test_very_long_white_space_is_packed():
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    encode, tokenizer = packing.byte_bpe(path), Tokenizer.from_file(path)
    for text in ("a " + " " * 120_000 + "b<|endoftext|> c", "\n" * 150_000, "x" + " " * 5_000_000, " " * 99_999 + "y"):
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_words_are_proposed_and_only_failing_ones_merged(monkeypatch):
    path = f"{queries.TOKENIZERS}/word_bpe_49k.json"
    tokenizer, own, merged = Tokenizer.from_file(path), bpe.WordBpe(path), []
    tokenizer.no_truncation()
    merge = own._merge
    monkeypatch.setattr(own, "_merge", lambda ids: merged.append(len(ids)) or merge(ids))
    rng = random.Random(12)
    common = ["the", "ing", "tion", "inter", "nation", "al", "lower", "case", "é", "ß", "qz", "xx"]
    words = ["".join(rng.choice(common) for _ in range(rng.randint(20, 120))) for _ in range(400)] + ["x" * 200_000, "!?" * 5000, "ab" * 300]
    for text, (ids, decoded) in zip(words, own.encode(words), strict=True):
        said = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == said and decoded == tokenizer.decode(said, skip_special_tokens=False)
    assert 0 < len(merged) < len(words)  # some proposals pass, some fail


def test_bpe_is_that_of_the_library(spark):
    path = f"{queries.TOKENIZERS}/word_bpe_49k.json"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéßσΣ0123456789 '.-_😀\n한"
    df = frame(spark, TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)])
    for row, r in zip(sorted(df.collect(), key=str), sorted(bpe.encode_and_decode(df, path).join(df.withColumnRenamed("ids", "other"), F.col("id").eqNullSafe(F.col("doc_id"))).collect(), key=str), strict=False):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        if r.id != 3:  # an id that stands for two texts
            assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) == (len(ids), ids, tokenizer.decode(ids, skip_special_tokens=False)), row
    assert bpe.encode_and_decode(empty(spark), path).collect() == []


def test_chat_comes_back(spark):
    rows = [(i % 4, i, ("user", "assistant", None, "a\nb<|im_end|>")[i % 4 if i < 8 else 1], t) for i, t in enumerate(TEXTS)] + [(None, None, "assistant", "x"), (2, 5, "user", "tie"), (2, 5, "user", "tie")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == set(turns)
    for c, own in turns.items():
        own.sort()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


def test_repeated_lines_go_everywhere(spark):
    texts = [*TEXTS, *(f"own {i}\n\tMenu \n{'menu' if i % 2 else 'x'}\nRare" for i in range(9)), "MENU", "\n".join(f"l{i}" for i in range(500)), "Rare\nmenu\nmenu"]
    df = frame(spark, texts, "n_lines string, kept_text int, h1 string")
    rows = df.collect()
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    docs = Counter(k for r in rows for k in {key(x) for x in (r.text or "").split("\n")} if k)
    said = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if docs[key(x)] < 10 or not key(x)]
        said.append((r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_repeated_lines(df).collect()]
    assert sorted(got, key=str) == sorted(said, key=str)
    assert sum(s[2] for s in said) >= 20
    assert line_dedup.drop_repeated_lines(empty(spark)).collect() == []


def test_line_runs_compact_and_carry_no_hot_line_again(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    batch = spark.createDataFrame([("a\nb",), ("c",)], "text string")
    sizes = []
    for _ in range(5):
        runs.add(batch)
        sizes.append([(n, table and table.rows().agg(F.sum("n_docs")).first()[0]) for table, n in runs.levels])
    # Two runs make one of the next level; each line comes to the limit with the third batch, later batches bring nothing.
    assert sizes == [[(1, 3)], [(0, None), (1, 6)], [(1, 3), (1, 6)], [(0, None), (0, None), (1, 9)], [(1, None), (0, None), (1, 9)]]
    plan = runs.fresh(runs.counts(batch))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2
    assert plan.count("Exchange") == 2  # both of the batch itself
    assert runs.at_limit().count() == 3 and [n for _, n in runs.levels] == [0, 0, 0, 1]
    plan = runs.at_limit()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    runs.drop()


def test_query_batches_are_compacted_and_joined(spark):
    levels = []

    class Seen(line_dedup.LineRuns):
        def _put(self, level, rows):
            levels.append((level, rows._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")))
            super()._put(level, rows)

    df = frame(spark, TEXTS + [f"own {i}\nmenu" for i in range(30)])
    runs = Seen(spark, fanout=4)
    line_dedup.count_in_batches(df, runs, 6)
    assert levels == [(0, 0), (0, 1), (0, 1), (0, 1), (1, 0), (0, 1), (0, 2)]
    runs.drop()


def test_lines_at_the_limit_beyond_what_may_be_sent(spark):
    df = frame(spark, [*TEXTS, *(f"own {i}\n\tMenu \n{'menu' if i % 2 else 'x'}\nRare" for i in range(12)), "Rare\nmenu\nmenu"])
    small, large = (sorted(map(tuple, line_dedup.drop_repeated_lines(df, max_sent=n).collect()), key=str) for n in (0, 1000))
    assert small == large and any(r[6] for r in small)


def test_exact_copies_and_later_batches(spark):
    texts = [*TEXTS, "a b", "ab", "a  b", "A b", " a\nb "]
    df = frame(spark, texts, "digest string, keep_id int, kept string")
    bare = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    rows = df.collect()

    def said(of, among):
        groups = defaultdict(list)
        for r in among:
            groups[bare(r.text)].append(r)
        best = {k: min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)).doc_id for k, g in groups.items()}
        return sorted(((r.doc_id, best[bare(r.text)], len(groups[bare(r.text)]), r.doc_id == best[bare(r.text)], hashlib.sha256(bare(r.text).encode()).hexdigest()) for r in of), key=str)

    got = lambda frame: sorted(((r.id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in frame.collect()), key=str)
    assert got(exact_dedup.in_batches(df)) == said(rows, rows)
    index = exact_dedup.DigestIndex(spark)
    assert got(index.add(df)) == said(rows, rows)
    # Longer, as long with a smaller id, shorter, null id; and a text that is new.
    more = spark.createDataFrame([(900, " a   b "), (-5, "HELLO  world"), (-6, "Hello world"), (901, "Helloworld"), (None, "x" * 3000), (902, "quite new")], "doc_id long, text string")
    new = more.collect()
    assert got(index.add(more)) == said(new, rows + new)
    assert got(index.resolve(exact_dedup.digests(df))) == said(rows, rows + new)
    n = len({bare(r.text) for r in rows + new})
    assert index.rows().count() == index.rows().select("digest").distinct().count() == n  # appended once each
    assert index.changes.rows().count() == 3
    index.drop()
    assert exact_dedup.in_batches(empty(spark)).collect() == []


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_patterns_whatever_the_text(spark):
    rng = random.Random(4)
    pieces = ["a", "b.", "@", "@", "1", "23", "4", ".", " ", "-", "+", "_", "(", ")", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "4207051279108084", "é", "😀", "\n", "255.", "..", "--", "%", "+1 234 567 8901", "0", "00255"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", "1" * 20000, "1 " * 10000, "a@b" + ".c" * 10000, "a" * 30000 + "@", "1." * 10000]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans int, _other string")
    got = {r.doc_id: r for r in pii.sanitise(df).withColumn("base", pii.written(F.filter("spans", lambda s: s["kind"] != "term"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].base == base_spans(t or "")
        assert (got[i].clean_text == (t or "")) == (not got[i].spans)
    assert pii.sanitise(empty(spark)).collect() == []


def test_telling_terms_are_generalised(spark):
    people = [(i, f"word{'abcdefgh'[i]} Zorblax met{'xyzuvw'[i]} write to bob@example.org today {'pqrstu'[i] * 5} now") for i in range(5)]
    copies = [(50 + i, f"Only copies say Grumpf near eve@example.org again {i}") for i in range(5)]
    others = [(100 + i, f"today now common write nothing number {i}") for i in range(60)] + [(7, None), (8, "Zorblax alone")]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(people + copies + others, "doc_id long, text string")).collect()}
    assert got[0].clean_text == "worda [TERM] metx write to [EMAIL] today ppppp now"
    assert all([s.value for s in got[i].spans] == ["bob@example.org", "Zorblax"] for i in range(5))
    assert all([s.kind for s in got[50 + i].spans] == ["email"] for i in range(5))  # one neighbourhood
    assert got[8].clean_text == "Zorblax alone" and all(not got[100 + i].spans for i in range(60))


def telling(rows, reach=10**9, disclosure=0.9, contexts=3):
    """doc_id -> terms to generalise, counted by hand."""
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    term = re.compile(r"\0[^ ]*|[^\W_](?:[^\W_]|-(?=[^\W_]))*")
    words = {t: term.findall(pattern.sub(lambda m: f" \0{m[0]} ", t or "").lower()) for t in {t for _, t in rows}}
    plain = {t: set(re.findall(r"[^\W_](?:[^\W_]|-(?=[^\W_]))*", (t or "").lower())) for t in words}
    n_e, n_t, n_te, around = Counter(), Counter(), Counter(), defaultdict(set)
    for _, t in rows:
        w = words[t]
        n_e.update({x for x in w if x[0] == "\0"})
        n_t.update(plain[t])
        pairs = set()
        for i, e in enumerate(w):
            if e[0] == "\0":
                for j in range(max(0, i - reach), min(len(w), i + reach + 1)):
                    if w[j][0] != "\0":
                        pairs.add((e, w[j]))
                        around[e, w[j]].add(tuple(re.sub(r"\d", "", w[k]) if 0 <= k < len(w) else "" for k in (j - 1, j + 1)))
        n_te.update(pairs)
    n, out = len(rows), defaultdict(set)
    for (e, x), k in n_te.items():
        information = np.log2(n / n_e[e])
        if len(around[e, x]) >= contexts and information > 0 and np.log2(k * n / (max(n_t[x], k) * n_e[e])) >= disclosure * information:
            for i, t in rows:
                w = words[t]
                if any(e == w[a] and x == w[b] for a in range(len(w)) for b in range(max(0, a - reach), min(len(w), a + reach + 1))):
                    out[i].add(x)
    return out


def test_terms_are_those_counted_by_hand(spark):
    rng = random.Random(9)
    names, fill = [f"name{c}" for c in "abcdefghij"], [f"w{c}{d}" for c in "abcdefg" for d in "abcdefg"]
    rows = []
    for i in range(150):
        words = [rng.choice(fill) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(10)
            at = rng.randrange(len(words))
            words[at : at + 2] = [f"{names[k]}@example.org", *rng.sample(fill, rng.choice((0, 1, 30))), names[k], rng.choice(["", f"{names[k]}-{k}", f"only{i}"])]
        rows.append((i, " ".join(words)))
    rows += [(150, rows[3][1]), (151, None), (152, " ".join(f"namea u{j % 9} a{j}@example.org" for j in range(300)))]
    said = telling(rows)
    got = {r.doc_id: {s.value.lower() for s in r.spans if s.kind == "term"} for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(map(len, said.values())) > 5
    assert {i: x for i, x in got.items() if x} == dict(said)


def test_a_term_tells_however_far_from_the_entity(spark):
    rows = [(i, f"{'abcdefgh'[i] * 4} Zebulon {'stuvwxyz'[i] * 4} " + " ".join(f"fill{j}" for j in range(60)) + " zeb@example.org and zeb2@example.org") for i in range(8)]
    rows += [(100 + i, " ".join(f"fill{j}" for j in range(60)) + f" {i}") for i in range(80)]
    got = {r.doc_id: {s.value for s in r.spans if s.kind == "term"} for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == {"Zebulon"} for i in range(8)) and not any(got[100 + i] for i in range(80))


def test_terms_of_rare_entities_and_of_any_form(spark):
    rows = [(1, "Lee wrote, then asked EMP-4471 about it. Why Lee left for EMP-4471 is open; so Lee has mail lee7@example.org, and EMP-4471 too")]
    rows += [(10 + i, f"wrote then asked about it why left for is open so has mail and too number {i}") for i in range(80)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].clean_text == "[TERM] wrote, then asked [TERM] about it. Why [TERM] left for [TERM] is open; so [TERM] has mail [EMAIL], and [TERM] too"
    assert all(not got[10 + i].spans for i in range(80))


@pytest.mark.parametrize(
    ("html", "said"),
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
        ("<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>First  long\n paragraph of the text &eacute; here.</p><p>Second<br>one, rather long as well.</p></article><div class='comments'><p>Great post</p></div><footer>(c)</footer></body></html>", "Title\nFirst long paragraph of the text é here.\nSecond one, rather long as well."),
        ("<body><header>Site</header><main><p>Body text of some length, in main.</p><aside>Ad</aside><script>var x = '<p>no</p>';</script><form>Subscribe</form></main><p>Cookie notice</p></body>", "Body text of some length, in main."),
        ("<div>" * 3000 + "deep text" + "</div>" * 3000, "deep text"),
    ],
)
def test_main_text(html, said):
    assert html_text.main_text(html or "") == said


_FIRST, _SECOND = "First sentence of a long running text that goes on, " * 6 + "here.", "Second sentence of the same running text, also long, " * 6 + "there."


@pytest.mark.parametrize(
    ("html", "said"),
    [
        ("<body><div class='wrapper has-sidebar'><article><p>{0}</p><p>{1}</p></article><div class='sidebar'><p>Side words</p></div></div></body>", "{0}\n{1}"),
        ("<body><div class='has-sidebar'><form>Search words</form><p>{0}</p><p>{1}</p></div></body>", "{0}\n{1}"),
        ("<body><div class='no-sidebar'><div><p>{0}</p><p>{1}</p></div><div class='sidebar'><p>Side words</p></div></div></body>", "{0}\n{1}"),
        ("<body><nav><a href=x>Home</a></nav><div class='elementor-widget-theme-post-content'><p>{0}</p><p>{1}</p></div><div class='share'><a href=y>Share</a></div></body>", "{0}\n{1}"),
        ("<body><article><h2 id='legal'>Legal</h2><p>{0}</p><p class='notice'>Noted here.</p><section id='search'><p>{1}</p></section><div class='ad'>Buy now</div><p>So <span class='social'>social</span> it is.</p></article></body>", "Legal\n{0}\nNoted here.\n{1}\nSo social it is."),
        ("<body><form><div class='cookie'><p>Cookie words</p></div><p>{0}</p><p>{1}</p></form></body>", "{0}\n{1}"),
        ("<body><div class='cookie'><p>Cookie words</p></div><form><p>{0}</p><p>{1}</p></form></body>", "{0}\n{1}"),
    ],
)
def test_names_alone_do_not_remove_text(html, said):
    assert html_text.main_text(html.format(_FIRST, _SECOND)) == said.format(_FIRST, _SECOND)


_EVEN = [f"A sentence of even length about the harbour and its boats, told once more in full words {i}." for i in range(7)]
_ARTICLE, _SAID = "".join(f"<p>{t}</p>" for t in _EVEN[:6]), "\n".join(_EVEN[:6])
_REMARK = "I read this and have much to say about it, at length. " * 8


def _remarks(look="", signs=""):
    return "".join(f"<div{look}>{signs}<p>{_REMARK}{i}</p></div>" for i in range(8))


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div id='main'>{}</div>", "<div class='post has-comments'>{}</div>"])
@pytest.mark.parametrize("name", ["cookie-notice", "advert", "newsletter-signup", "ad", "comments", "related-posts", "sponsored"])
def test_marked_boxes_go_on_even_pages(around, name):
    assert html_text.main_text("<body>" + around.format(f"{_ARTICLE}<div class='{name}'><p>{_EVEN[6]}</p></div>") + "</body>") == _SAID


@pytest.mark.parametrize(
    "remarks",
    [
        f"<section id='comments'>{_remarks(' class=comment')}</section>",
        f"<section id='comments'>{_remarks()}</section>",
        f"<section><h2>8 Comments</h2>{_remarks()}</section>",
        f"<div class='x'>{_remarks(' class=c', '<span class=author>Jo</span><time>May 4</time>')}</div>",
        f"<div class='discussion'>{_remarks(' class=c')}</div>",
        f"<div class='discussion'><p>{_REMARK}</p><p>{_REMARK}</p></div>",
    ],
)
def test_comments_go_however_long(remarks):
    assert html_text.main_text(f"<body><div class='post'><p>{_EVEN[0]}</p><p>{_EVEN[1]}</p></div>{remarks}</body>") == "\n".join(_EVEN[:2])


@pytest.mark.parametrize("look", ["id='search'", "class='related-work'", "id='legal'", "class='discussion'"])
@pytest.mark.parametrize("heading", ["", "<h2>Head</h2>"])
def test_sections_of_an_article_stay_whatever_their_name(look, heading):
    got = html_text.main_text(f"<body><article>{_ARTICLE}<section {look}>{heading}<p>{_EVEN[6]}</p></section></article></body>")
    assert got == _SAID + ("\nHead" if heading else "") + f"\n{_EVEN[6]}"


def test_an_advert_is_no_text_of_a_page_whose_article_is_a_title():
    assert html_text.main_text("<body><div class='ad'>Buy this fine thing of ours today.</div><article><h1>Title</h1></article></body>") == "Title"
    widgets = "".join(f"<div class='elementor-widget-text'><p>{t}</p></div>" for t in _EVEN[:6])
    assert html_text.main_text(f"<body><div>{widgets}</div></body>") == _SAID


@pytest.mark.parametrize(
    "html",
    [
        "<html><head><title>T</title><meta name=x><body><nav><a href=x>Home</a></nav><article><p>{0}</p><p>{1}</p></article></body></html>",
        "<head><title>T</title><p>{0}</p><p>{1}</p>",
        "<body><div class='layout has-sidebar'><article><p>{0}</p><p>{1}</p></article></div></body>",
        "<body><div id='page-with-menu'><p>{0}</p><p>{1}</p></div></body>",
        "<body><div class='legal-article'><p>{0}</p><p>{1}</p></div></body>",
        "<body><div class='search-content'><p>{0}</p><p>{1}</p></div></body>",
        "<body><noscript><article><p>{0}</p><p>{1}</p></article></body>",
        "<body><noscript><p>Switch it on</p></noscript><article><p>{0}</p><p>{1}</p></article></body>",
        "<body><button>Menu<article><p>{0}</p><p>{1}</p></article></body>".replace("Menu", ""),
        "<body><svg><path d='x'><article><p>{0}</p><p>{1}</p></article></body>",
        "<body><svg/><article><p>{0}</p><p>{1}</p><!-- a note without end </article></body>",
        "<body><article><p>{0}</p><script>if (a < b) document.write('<p>no</p>')</script><p>{1}</p></article><script>x = '<article>'",
    ],
)
def test_broken_markup(html):
    assert html_text.main_text(html.format(_FIRST, _SECOND)) == f"{_FIRST}\n{_SECOND}"


@pytest.mark.parametrize("junk", ["<a ", "<!--", "<![CDATA[", "</", "<div>x", "<main>x", "<noscript>x", "<li></li>", "<p>", "<option>", "&lt", "<a x='", "<form><div class=ad>x"])
def test_time_is_linear_in_junk(junk):
    def took(n):
        began = time.process_time()
        html_text.main_text("<b><div>" + "<a>" * (n // 100) + junk * (n // len(junk)) + "</b>" * (n // 100))
        return time.process_time() - began

    assert took(400_000) < 12 * took(100_000) + 0.5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the shared tables")
def test_words_are_those_of_the_article_elements(spark):
    kept = wrong = missed = 0
    for row in queries.op2_html_text(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = row.html[row.html.index("<article") : row.html.rindex("</article>")]
        inner = re.sub(r"(?s)<!--.*?-->|<(script|style|aside|form|nav|footer)\b.*?</\1>", " ", inner)
        said, got = (Counter(t.split()) for t in (html.unescape(re.sub("<[^>]*>", " ", inner)), row.text))
        kept += sum((said & got).values())
        wrong += sum((got - said).values())
        missed += sum((said - got).values())
    assert kept > 1000 and kept / (kept + wrong) > 0.99 and kept / (kept + missed) > 0.99


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a</p>", "y"), (1, "u", None, "x")], "page_id long, url string, html string, text string")
    assert sorted(((r.id, r.url, r.text) for r in html_text.extract(df).collect()), key=str) == sorted([(1, "u", ""), (1, "u", ""), (None, None, "a")], key=str)
    assert html_text.extract(df.limit(0)).collect() == []


def test_nearest_examples_are_exact_and_scores_separate(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    bad, common = ["nastyone", "vilething", "horrorful"], [word() for _ in range(200)]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choice(common) for _ in range(30)) + (f" {rng.choice(bad)}" if toxic else ""), int(toxic)))
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "y"), (None, "nastyone", "z")], "doc_id long, text string, nearest string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 200] + [(None, 1), (5, None), (12345, 1)], "doc_id long, label int")
    bank = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, bank).collect()}
    assert len(got) == 403 and all(0 <= r.toxic_score <= 1 for r in got.values())
    held = [(got[i].toxic_score >= 0.7) == bool(y) for i, _, y in rows if i >= 200]
    assert sum(held) >= 0.95 * len(held)
    assert got[900].toxic_score == got[901].toxic_score < 0.5
    assert all(got[i].nearest for i, _, _ in rows) and not got[900].nearest
    assert toxicity.score(df, toxicity.fit(df, labels.limit(0))).where("toxic_score > 0.001").count() == 0
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels)).collect() == []


def test_neighbours_are_those_of_a_dense_product():
    rng = random.Random(7)
    languages = [["".join(rng.choice(s) for _ in range(rng.randint(2, 9))) for _ in range(3000)] for s in ("abcdefg", "hijklmn", "opqrsté")]
    texts = [" ".join(rng.choice(words[: rng.choice((20, 300, 3000))]) for _ in range(rng.randint(1, 200))) for words in (languages[i % 3] for i in range(900))]
    texts[5] = texts[8] = texts[11]
    labels = np.array([i % 7 == 0 for i in range(900)], np.int64)
    found = list(toxicity.TermCounts()(texts))
    row, hashes, n = np.repeat(np.arange(900), [len(h) for h, _ in found]), np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])
    twins = np.array([zlib.crc32(t.encode()) for t in texts])
    documents = lambda keys: (5000, 1 + np.arange(len(keys)) % 700)
    bank = toxicity.bank_of(np.arange(900), labels, twins, row, hashes, n, documents, 25)
    assert len(bank.dense) and (bank.frequent < 0).any() and bank.blocks > 8
    # Weights made again from the definition, over all terms.
    keys, term = np.unique(hashes, return_inverse=True)
    matrix = np.zeros((900, len(keys)))
    matrix[row, term] = 1 + np.log(n)
    ones, every = (matrix[labels == 1] > 0).sum(0), (matrix > 0).sum(0)
    matrix *= np.log(5001 / (1 + np.arange(len(keys)) % 700 + 0.5)) * toxicity.told(ones, every - ones, int(labels.sum()), int((1 - labels).sum()))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    cosines = matrix @ matrix.T
    vectors = [bank.vector(t, c) for t, c in toxicity.TermCounts(bank.keys)(texts)]
    for twin in (False, True):
        for low in range(0, 900, 50):
            at = range(low, low + 50)
            for i, (rows, sims) in zip(at, bank.nearest([vectors[i] for i in at], [int(twins[i]) for i in at] if twin else None), strict=True):
                said = np.where(twins == twins[i], -1, cosines[i]) if twin else cosines[i]
                assert np.allclose(np.sort(said)[::-1][: len(sims)], sims, atol=1e-6) and len(sims) == min(25, (said > 1e-9).sum())
                assert np.allclose(said[bank.ids[rows]], sims, atol=1e-6)


def test_unknown_words_lower_the_cosine():
    texts = [f"alpha{c} beta{c} gamma common" for c in "abcdefgh"]
    found = list(toxicity.TermCounts()(texts))
    row, hashes, n = np.repeat(np.arange(8), [len(h) for h, _ in found]), np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])
    bank = toxicity.bank_of(np.arange(8), np.arange(8) % 2, np.arange(8), row, hashes, n, lambda keys: (100, np.full(len(keys), 3)), 3)
    asked = ["alphaa betaa gamma common", "alphaa betaa gamma common other zoo", "alphaa betaa gamma common " + " ".join(f"zzz{a}{b}" for a in "abcdefghij" for b in "klmnopqrst")]
    vectors = [bank.vector(t, c) for t, c in toxicity.TermCounts(bank.keys, strangers=True)(asked)]
    for text, (terms, weights), (_, sims) in zip(asked, vectors, bank.nearest(vectors), strict=True):
        every, counts = next(iter(toxicity.TermCounts()([text])))
        at = np.searchsorted(bank.keys, every).clip(max=len(bank.keys) - 1)
        own = bank.keys[at] == every
        whole = (1 + np.log(counts)) * np.where(own, bank.weight[at], bank.strange)  # over all terms of the text
        base = {int(k): w for k, w in zip(found[0][0], (1 + np.log(found[0][1])) * bank.weight[np.searchsorted(bank.keys, found[0][0])], strict=True)}
        said = sum(w * base.get(int(k), 0) for k, w in zip(every, whole, strict=True)) / np.linalg.norm(whole) / np.linalg.norm(list(base.values()))
        assert abs(sims[0] - said) < 1e-6 and len(terms) == own.sum() == len(weights)
    near = [s[0] for _, s in bank.nearest(vectors)]
    assert abs(near[0] - 1) < 1e-6 and near[0] > near[1] > near[2] > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the shared tables")
def test_scores_hold_on_labels_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    right = sum(r.predicted == r.toxic for r in rows)
    assert len(rows) > 20 and right >= 0.9 * len(rows)


def test_words_of_ascii_text_are_those_of_any_text():
    from quarry.llm import toxicity

    for text in ("", " ", "It's 2ND-row_x ABC\x00def\x7f[\\]{|}~@`", "ÀB Straße İx naïve_9", "".join(map(chr, range(128))), "".join(map(chr, range(300)))):
        assert toxicity.words_of(text) == toxicity._WORD.findall(text.lower())


def test_terms_of_a_word_are_the_word_and_its_beginnings():
    from xxhash import xxh64_intdigest

    from quarry.llm import toxicity

    (terms, counts), (none, _) = toxicity.TermCounts()(["Abcdefg abcd abc abcd", "12"])
    made = {xxh64_intdigest(w): n for w, n in {"abcdefg": 1, "abcd^": 3, "abcdef^": 1, "abcd": 2, "abc": 1}.items()}
    assert dict(zip(terms.tolist(), counts.tolist(), strict=True)) == made and not len(none)


def test_tokens_hold_the_words_of_any_text():
    rng = random.Random(12)
    texts = ["".join(rng.choice("aBz ZqK\t.'_7\u00e9\u00c9\u0130\u0131\u212a\u0301\u2019\u03a3\u03c2\u0391\u00df\u4e2d\u0661\u00a0\U0001d400") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for text in texts:
        assert [w for token in toxicity.tokens_of(text) for w in toxicity.words_of(token.decode())] == toxicity.words_of(text)


def test_texts_are_counted_once_for_a_term_however_often_it_occurs(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TABLE", 5)
    monkeypatch.setattr(toxicity, "CHUNK", 30)
    rng = random.Random(13)
    words = ["abcd", "abcdef", "abcdefg", "abcdxyz", "caf\u00e9teria", "caf\u00e9s", "na\u00efve", "abcdef\u2019s", "\u0391\u03a3", "x", "BCDE", "ccde", "12"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    terms = lambda text: [t for w in toxicity.words_of(text) for t in (w, *((w[:n], n) for n in toxicity.PREFIXES if len(w) >= n))]
    found = list(toxicity.TermCounts()(texts))
    for text, (_, n) in zip(texts, found, strict=True):
        assert sorted(n.tolist()) == sorted(Counter(terms(text)).values())
    keys = np.unique(np.concatenate([t for t, _ in found]))
    every = Counter(t for text in texts for t in set(terms(text)))
    assert len(keys) == len(every) == len(np.unique(keys >> np.uint64(1)))
    seen = np.zeros(len(keys), np.int64)
    toxicity.TermCounts(keys).present(texts, seen)
    assert sorted(seen.tolist()) == sorted(every.values())
