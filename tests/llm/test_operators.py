"""Operators against brute force, libraries and edge cases on small tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from aforo.llm import chat_format, decontaminate, exact_dedup, near_dedup, pii, sentencepiece_codec, sharding, suffix_dedup, toxicity, url_filter
from aforo.llm.graph import components

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000


def docs(spark, rows, extra=True):
    """Rows with other columns, whose names clash with those the operators use."""
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, row string").repartition(3)
    return df if extra else df.select("doc_id", "text")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


# 1 SentencePiece


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.read_model())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("text", ["", " ", "a", "  a  b ", "a\nb\r\n\n", "▁x▁▁", "\x00a\x7f", "ﬁ Å ①", "日本語テキスト", "a\tb", "</s>[INST]<0x0A>", "😀👩‍👩‍👧", "\ufeffa", "a" * 3000, "=-" * 500, " " * 77, "straße naïve coöperate", "def f(x):\n    return x\n"])
def test_codec_equals_library(codec, library, text):
    ids = codec.encode(text, True, True)
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert codec.decode(ids) == library.decode(ids)


def test_codec_on_random_texts_and_ids(codec, library):
    rnd = random.Random(0)
    for _ in range(400):
        text = "".join(rnd.choice("abcdeé ñ▁\n01 .,日") for _ in range(rnd.randrange(60)))
        assert codec.encode(text) == library.encode(text)
        ids = [rnd.randrange(3, 259) if rnd.random() < 0.5 else rnd.randrange(32000) for _ in range(rnd.randrange(10))]
        assert codec.decode(ids) == library.decode(ids)


def test_encode_rows(spark, library, empty):
    rows = [(1, None), (2, ""), (2, "a b"), (None, "a b"), (3, LONG)]
    out = sentencepiece_codec.encode(docs(spark, rows), sentencepiece_codec.read_model())
    got = collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded, r.ids_sha256) for r in out.collect())
    want = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), tuple(ids), library.decode(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    assert got == want
    assert sentencepiece_codec.encode(empty, sentencepiece_codec.read_model()).count() == 0


def test_stretches_asked_again_stay_in_a_full_cache(library):
    codec, made = sentencepiece_codec.Codec(sentencepiece_codec.read_model()), []
    codec.limit, ids_of = 8, codec._ids_of
    codec._ids_of = lambda s: made.append(s) or ids_of(s)
    for i in range(100):
        assert codec.encode(f"the w{i}q") == library.encode(f"the w{i}q")
    assert made.count("▁the") == 1 and len(made) == 101 and len(codec.cache) + len(codec.older) <= 8


# 2 chat


def test_escape_round_trip():
    rnd = random.Random(1)
    parts = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "[", "s>", "a", "\n", " ", "%"]
    for _ in range(3000):
        text, role = ("".join(rnd.choice(parts) for _ in range(rnd.randrange(9))) for _ in range(2))
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text and not any(c in escaped for c in chat_format.CONTROL)
        assert [t[:2] for t in chat_format.read_turns(chat_format.template([(role, text), ("b", "x")]))] == [(role, text), ("b", "x")]


def test_rewriting_template_is_detected(spark):
    def forgetful(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 or r != 'assistant' else '...'}\n" for i, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "long thought"), (1, 2, "user", "and"), (2, 0, None, None), (None, None, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat_format.format_turns(turns, forgetful).collect()}
    assert got[1, 2].rewritten and not got[1, 1].rewritten
    assert got[1, 1].segment == "<assistant>long thought\n" and got[1, 1].loss
    plain = {(r.conv_id, r.turn): r for r in chat_format.format_turns(turns, context=2).collect()}
    whole = {(r.conv_id, r.turn): r for r in chat_format.format_turns(turns).collect()}
    assert plain == whole and not any(r.rewritten for r in plain.values())  # no more than two turns before
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    assert back[1].loss_chars == 12 and back[2].n_turns == 1 and back[None].n_turns == 1
    assert chat_format.read_back(chat_format.format_turns(turns.limit(0))).count() == 0


def test_a_template_that_looks_far_back(spark):
    """Rewrites a turn ten back: seen at once with whole prefixes; a window says that it has not looked."""

    def fading(turns):
        return "".join(f"<{r}>{t if i > len(turns) - 10 else '.'}\n" for i, (r, t) in enumerate(turns))

    turns = spark.createDataFrame([(1, i, "user", f"text {i}") for i in range(40)] + [(2, 0, "user", "a" * 300_000)], "conv_id long, turn long, role string, text string").withColumn("segment", chat_format.F.lit("mine"))
    flags = lambda **kw: [r.rewritten for r in chat_format.format_turns(turns, fading, **kw).filter("conv_id = 1").orderBy("turn").collect()]
    assert flags() == [i >= 9 for i in range(40)] == flags(context=40)
    assert flags(context=2) == [False] * 3 + [None] * 37 and flags(context=12) == [i >= 9 for i in range(40)]
    whole, part = ({r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns, **kw)).collect()} for kw in ({}, {"context": 2}))
    assert part[2].n_turns == 1 and part[1].n_turns == 40 and part[1].rewritten is None and part[2].rewritten is False and whole[1].rewritten is False
    assert part[1][:-1] == whole[1][:-1]


@pytest.mark.parametrize("chars", [10, 20_000])
def test_history_rewritten_late(chars):
    """The first turn is cut from the 301st turn on, in short and in long texts."""

    def cutting(turns):
        return "".join(f"<{r}>{'CUT' if i == 0 and len(turns) > 300 else t}\n" for i, (r, t) in enumerate(turns))

    made = chat_format.Rendering(cutting, None)
    assert [i for i in range(330) if made.add(("user", f"{i} " + "x" * chars))[1]] == [300]


def test_repeated_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, None, "user", "first")], "conv_id long, turn long, role string, text string")
    got = chat_format.read_back(chat_format.format_turns(turns)).collect()[0]
    assert got.n_turns == 4 and got.turns_sha256 == hashlib.sha256(b"user\nfirst\nassistant\na\nuser\nb\nuser\nb\n").hexdigest() and got.loss_chars == 1


# 3 decontamination


def test_canonical_arrays_equal_plain():
    import pyarrow as pa

    rnd = random.Random(2)
    texts = [None, "", LONG] + ["".join(rnd.choice([" ", "\n", " Tom", "Ann.", " 5", " kg", " hours", "7h", " 8miles", " The", " two", " ...", "x", "\t", "A", "é ", "..\n", " 3%", " T. ", " DeShawn", " O'Brien ", " TOM ", " NASA", " Ann-Marie", " I "]) for _ in range(rnd.randrange(14))) for _ in range(500)]
    made = decontaminate.Canonical(pa.array(texts))
    for i, t in enumerate(texts):
        words, values, lows = decontaminate.canonical(t or "")
        a, b = made.offsets[i], made.offsets[i + 1]
        assert b - a == len(words) and [made.low(j) for j in range(a, b)] == lows
        assert [(made.values(j, 1) or [""])[0] for j in range(a, b)] == values


def test_a_worker_keeps_the_tables_of_one_operator():
    """The words that op3 keeps and the codec that op1 keeps go as soon as the worker has a task of another operator."""
    import gc
    import weakref

    import pyarrow as pa

    from aforo.llm.common import slices

    texts = pa.RecordBatch.from_pydict({"text": ["some words"]})
    words = weakref.ref(decontaminate.Canonical(texts.column("text")).known)
    codec = weakref.ref(sentencepiece_codec._codec(sentencepiece_codec.read_model()))
    gc.collect()
    assert words() is None and codec() is sentencepiece_codec._codec(sentencepiece_codec.read_model())
    assert len(list(slices([texts], "text"))) == 1
    gc.collect()
    assert codec() is None
    known = weakref.ref(decontaminate.Canonical(texts.column("text")).known)
    assert known() is decontaminate.Canonical(texts.column("text")).known


def template_windows(text, k):
    """(place, key, slot values) of each window of k words, as the module's description says."""
    words, values, lows = decontaminate.canonical(text or "")
    if k < decontaminate.LITERAL:
        return [(0, ("whole", *lows), [v for v in values if v])] if 0 < len(words) == k else []
    out = []
    for i in range(len(words) - k + 1):
        own = [x for x in values[i : i + k] if x]
        out.append((i, ("template", *words[i : i + k]) if k - len(own) >= decontaminate.LITERAL else ("words", *lows[i : i + k]), own))
    return out


def brute_contaminated(rows, items, width=decontaminate.WINDOW):
    out, shift = set(), decontaminate.SHIFT
    for item, text in items:
        k = min(width, len(decontaminate.canonical(text or "")[0]))
        own = template_windows(text, k)
        keys = collections.defaultdict(list)
        for at, key, values in own:
            keys[key].append((at, values))
        for doc, t in rows:
            ways, seen = collections.defaultdict(list), set()
            for place, key, found in template_windows(t, k):
                for n, (at, values) in enumerate(keys.get(key, ())):
                    hit, d = (key, at, list(zip(values, found)), values == found), place - at
                    for way in ((0, 0), (1, d), (2, d // (2 * shift)), (3, (d + shift) // (2 * shift)))[n > 0 or key in seen :]:
                        ways[way].append(hit)
                if key in keys:
                    seen.add(key)
            for (kind, _), hits in ways.items():
                pairs = {p for h in hits for p in h[2]}
                clash = len(pairs) - len({a for a, _ in pairs})
                same = {h[1] for h in hits if h[3]}
                row = any(all(a + j in same for j in range(decontaminate.VERBATIM - width + 1)) for a in same)
                if len({h[0] for h in hits}) >= decontaminate.FOUND * len(keys) and clash <= len(pairs) * decontaminate.DISAGREE or kind == 1 and row:
                    out.add((doc, item))
    return out


def test_decontamination_equals_brute_force(spark, real, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    question = "If Tom has 3 apples and buys 5 kg of flour, then how much does Tom pay in total for everything today?"
    sums = ["What is 17 times 23?", "1 2 3 5 8 13 21 34 55", "The answer is", question.upper(), "Ann had three apples. Ann bought 5kg of flour in one hour. How much did Ann pay for all of it?"]
    items = items.unionByName(spark.createDataFrame([(900, question), (901, None), (902, "hi"), *enumerate(sums, 903)], "item_id long, text string"))
    more = [(9001, "x y. if Ann has 7 apples and buys 9 kg of flour, then how much does Ann pay in total for everything today? z"), (9002, "if Ann has 7 apples and buys 7 kg of flour, then how much does Bob pay in total for everything today?"), (9003, None), (9004, ""), (9005, "hi"), (9006, LONG)]
    more += [(9007, "so what is 17 times 23? none"), (9008, "what is 18 times 23?"), (9009, "see 1 2 3 5 8 13 21 34 55 89"), (9010, "1 2 3 5 8 13 22 34 55"), (9011, "the Answer is"), (9012, "so the answer is")]
    more += [(9013, "Bob had 4 apples. Bob bought seven kg of flour in 2 hours. How much did Bob pay for all of it?"), (9014, "x " * 40 + question[20:90] + " y" * 40), (9015, (question + " ") * 3 + LONG), (9016, "hi there")]
    table = real.unionByName(docs(spark, more, False))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, items).collect()}
    assert got == brute_contaminated([tuple(r) for r in table.collect()], [tuple(r) for r in items.collect()])
    assert {(9001, 900), (9005, 902), (9007, 903), (9009, 904), (9011, 905), (9013, 907), (9014, 900), (9015, 900)} <= got
    assert not {(9002, 900), (9008, 903), (9010, 904), (9012, 905), (9016, 902)} & got
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(table, items.limit(0)).count() == 0


def test_decontamination_after_another_use_of_the_template(spark):
    item = "If Tom has 3 apples and buys 5 kg of flour, then how much does Tom pay in total for everything today?"
    other = "If Ann has 7 apples and buys 9 kg of sugar while it rains, what will the shop earn this week?"
    inserted = item.replace("in total", "in the shop in total")
    rows = [(1, f"{other} {item}"), (2, f"{other} so {inserted}"), (3, f"{other} {other}"), (4, item)]
    items = spark.createDataFrame([(900, item)], "item_id long, text string")
    got = sorted(r.doc_id for r in decontaminate.contaminated(docs(spark, rows), items).collect())
    assert got == [1, 2, 4]


def test_items_asked_again_with_other_names_and_units(spark):
    """Held-out names, numbers and units: the share of items that is found, and texts of the same shape that are not."""
    people = ["TOM", "DeShawn", "O'Brien", "Ann-Marie", "Mary Ann", "T.", "McDonald", "Zoë", "J. R. Smith", "María José"]
    units = ["pints", "quarts", "h", "hectares", "cups"]
    shapes = [
        "A tank holds {a} {u} and is filled by {p} at a rate of {b} {u} each minute, while a leak loses {c} {u} each minute until it is full.",
        "Yesterday {p} walked {a} {u} to the market and bought {b} red apples for the children, then gave {c} of them to a friend.",
        "In the workshop {p} paints {a} chairs in {b} {u} and would like to know how long it takes to paint {c} chairs alone.",
        "On Monday the baker {p} sold {a} loaves of bread before noon and {b} loaves after noon, so how many loaves are left of {c}?",
    ]
    fill = lambda shape, p, u, n: shape.format(p=p, u=u, a=n + 40, b=n + 5, c=n + 2)
    items = [(i, fill(s, "Sam", "litres", 0)) for i, s in enumerate(shapes)]
    rows = [(100 * i + 10 * j + k, f"so here is one. {fill(s, p, u, 7 * j + k + 1)} What do you say") for i, s in enumerate(shapes) for j, p in enumerate(people) for k, u in enumerate(units)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), table).collect()}
    hits = {(d, d // 100) for d, _ in rows}
    assert len(got & hits) >= 0.9 * len(hits) and got <= hits
    shouted = [(i, t.upper()) for i, t in items]
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, shouted), table).collect()} == {(i, i) for i, _ in items}
    other = [(i, t.replace("apples", "pears and plums").replace("leak", "hole in it").replace("chairs", "old doors").replace("loaves", "bags of salt").replace("rate", "pace of at most").replace("children", "old neighbours down the road")) for i, t in rows[:20]]
    print("recall", len(got & hits) / len(hits), len({r.doc_id for r in decontaminate.contaminated(docs(spark, other), table).collect()}))


def test_items_with_null_or_equal_ids(spark):
    parts = [" ".join(f"{a}{i}" for i in range(12)).replace("0", "o").replace("1", "i").replace("2", "z") for a in ("ka", "lo", "mu")]
    parts = [re.sub(r"\d", "x", p) for p in parts]
    items = spark.createDataFrame([(None, parts[0]), (None, parts[1]), (7, parts[2]), (7, "q " * 30)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or -1) for r in decontaminate.contaminated(docs(spark, [(1, parts[0]), (2, parts[2]), (2, parts[2]), (None, parts[1])]), items).collect() if r.doc_id)
    assert got == [(1, -1), (2, 7), (2, 7)]


# 4 URLs


def test_url_rules(spark):
    rows = [(1, "http://WWW.Example.org/en/12?x"), (2, "http://example.org/es/"), (3, "https://a.com/fr/x#y"), (4, "x://b.com/de/"), (5, None), (6, "no scheme"), (7, "http://org"), (8, "http://notexample.org/es/q"), (9, "http://a.com://b/fr/"), (10, "http://casino-jackpot.example.com/" + "a" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.org", "/en/12", "example.org/en/1", "block")
    assert (got[2].rule, got[2].verdict) == ("example.org/es/", "block") and (got[3].rule, got[3].verdict) == ("com/fr/", "allow")
    assert (got[4].rule, got[4].verdict) == ("com/de/", "block") and (got[5].host, got[5].path, got[5].rule) == ("", "", None)
    assert got[6].rule is None and got[7].rule is None and got[7].path == "" and got[8].rule == "org/"
    assert got[9].host == "a.com:" and got[9].path == "//b/fr/"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


UNWANTED = "super-casino casino-royal7 best-pills viagra-shop online-poker free-bets24 m.free-bets spam-farm cheap-pills adult-x adult-chat hot-cams payday-cash fastloans keygen-crack warez-zone torrents-free spam-links ad-tracker9 click-bonus replica-watch xxx-clips sexy-dating bet-tips jackpot-city slots-of-fun".split()
ORDINARY = "old-library river-museum school-history weather-station cooking-tips local-news city-council physics-lectures tionsh ththnt essexlife free-books online-courses best-hikes mountain-huts poem-archive train-times harbour-news data-journal maths-help bird-songs medieval-history pillow-shop clickstream-papers roadside-cafe beta-release".split()


def judged(spark, urls):
    rows = [(i, u, y) for i, (u, y) in enumerate(urls)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host int")).collect()
    blocked = {r.page_id for r in out if r.verdict == "block"}
    hits = sum(y for i, _, y in rows if i in blocked)
    return hits / max(1, len(blocked)), hits / sum(y for _, _, y in rows)


def test_url_model_on_new_hosts_and_paths(spark):
    paths = [("/buy-viagra-online-casino", 1), ("/casino/bonus", 1), ("/cheap_loans", 1), ("/library/books", 0), ("/history-of-rome.html", 0), ("/2024/05/03/market-opens", 0)]
    urls = [(f"https://{h}.example.net/en/{i}", y) for y, hosts in ((1, UNWANTED), (0, ORDINARY)) for i, h in enumerate(hosts)] + [(f"https://old-library.example.net{p}", y) for p, y in paths]
    precision, recall = judged(spark, urls)
    assert precision >= 0.9 and recall >= 0.9


def test_url_model_on_hosts_left_out(spark):
    labelled = url_filter.labelled_urls(spark).withColumn("host", url_filter.host_and_path(url_filter.F.col("url"))[0])
    fifth = url_filter.F.crc32("host") % 5
    weights, bias = url_filter.train(labelled.filter(fifth != 0).select("url", "label"))
    host_at, path_at = url_filter._grams(*url_filter.host_and_path(url_filter.F.col("url")), len(weights) // 2)
    rows = labelled.filter(fifth == 0).select("label", (url_filter.score(host_at, path_at, weights, bias) >= url_filter.THRESHOLD).alias("blocked")).toPandas()
    hits = (rows.blocked & (rows.label == 1)).sum()
    print("precision", hits / rows.blocked.sum(), "recall", hits / (rows.label == 1).sum())
    assert len(rows) > 400 and hits >= 0.9 * rows.blocked.sum() and hits >= 0.9 * (rows.label == 1).sum()


def test_url_score_equals_mllib(spark):
    labelled = url_filter.labelled_urls(spark).limit(600)
    model = url_filter.fit(labelled, 1024)
    weights = tuple(model.coefficients.toArray().tolist())
    host_at, path_at = url_filter._grams(*url_filter.host_and_path(url_filter.F.col("url")), 1024)
    urls = labelled.unionByName(spark.createDataFrame([(None, 0.0), ("", 1.0), ("http://b/" + "x" * 5000, 0.0)], "url string, label double"))
    rows = model.transform(url_filter.vectors(urls, 1024)).select("probability", url_filter.score(host_at, path_at, weights, float(model.intercept)).alias("mine")).collect()
    assert all(abs(r.probability[1] - r.mine) < 1e-9 for r in rows)


def brute_rule(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


def test_url_rules_equal_brute_force(spark):
    rnd = random.Random(8)
    part = lambda *xs: "".join(rnd.choice(xs) for _ in range(rnd.randrange(4)))
    urls = [None, "", "://", "http://"] + [part("h", "http", ":", "//", "://") + part("a.", "example.", "Example.", "ORG", "org", "com", "x") + part("/", "/en/1", "/es/", "/fr/", "/de/", "?", "#", "a") for _ in range(1500)]
    urls += [f"https://{h}{p}" for h in ("example.org", "WWW.example.org", "com", "a.com", "xorg", "a.org") for p in ("", "/", "/en/1", "/en/12?x", "/es/", "/es", "/fr/a", "/de/#b", "?/fr/")]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] + [(7, urls[7], "again")], "page_id long, url string, path string")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(urls) + 1 and len({tuple(r) for r in got if r.page_id == 7}) == 1
    for r in got:
        u = urls[r.page_id] or ""
        tail = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", tail)[0]
        path = re.match("[^?#]*", tail[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1]) and (not rule or r.verdict == rule[0]), u


# 5 near duplicates


def brute_components(rows, k):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_equals_brute_force(spark, real, empty, k):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = [(10_000 + i, " ".join(w if rnd.random() > i / 400 else f"e{rnd.randrange(10**6)}" for w in base)) for i in range(60)]
    rows += [(20_000, None), (20_001, ""), (20_002, "One"), (20_003, "one "), (20_004, LONG), (20_005, LONG + "x")]
    table = real.unionByName(docs(spark, rows, False))
    got = {r.doc_id: r for r in near_dedup.near_dedup(table, k).collect()}
    want = brute_components([tuple(r) for r in table.collect()], k)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert near_dedup.near_dedup(empty, k).count() == 0


def test_groups_split_into_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(w if rnd.random() > 0.1 else f"e{rnd.randrange(10**6)}" for w in base)) for i in range(120)]
    monkeypatch.setattr(near_dedup, "HELD_SHINGLES", 900)
    monkeypatch.setattr(near_dedup, "BROADCAST_NODES", 0)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs(spark, rows, False)).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows, 2).items()}


def test_super_minhash_estimates_and_stops():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = a.copy()
    b[:100] = rng.integers(0, 2**63, 100, dtype=np.uint64)
    h = near_dedup.super_minhash(np.concatenate([a, b, a[:1]]), np.repeat([0, 1, 2], [400, 400, 1]), 3, 252)
    assert abs((h[0] == h[1]).mean() - 0.6) < 0.1 and len(set(h[2] >> 32)) == 252 and (h[0] >> 32).max() < 10


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 102), (102, 101), (7, 7)] + [(200, x) for x in range(201, 260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and {got[i] for i in (100, 101, 102)} == {100} and all(got[i] == 200 for i in range(200, 260))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 6 repeated passages


def brute_passages(rows, n=50):
    words = [(d, (t or "").encode().lower().split()) for d, t in rows]
    seen = collections.Counter(tuple(w[i : i + n]) for _, w in words for i in range(len(w) - n + 1))
    out = collections.Counter()
    for d, w in words:
        cover = []
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                if cover and cover[-1][1] >= i:
                    cover[-1][1] = i + n
                else:
                    cover.append([i, i + n])
        out.update((d, a, b) for a, b in cover)
    return out


def test_repeated_passages_equal_brute_force(spark, real, empty):
    rnd = random.Random(5)
    some = lambda n: [f"v{rnd.randrange(3000)}" for _ in range(n)]
    rows = []
    for _ in range(40):
        p = some(rnd.choice([49, 50, 51, 70, 200]))
        rows += [(50_000 + len(rows), " ".join(some(rnd.choice([0, 5, 80])) + p + some(rnd.choice([0, 10, 60])))) for _ in range(rnd.choice([2, 3, 12]))]
    rows += [(9000, None), (9001, ""), (9002, "ha " * 3000), (9003, "ha " * 49), (9004, "Same row " * 30), (9004, "Same row " * 30), (None, "same ROW\n" * 30)]
    table = real.unionByName(docs(spark, rows, False))
    want = brute_passages([tuple(r) for r in table.collect()])
    for most_bits in (suffix_dedup.MOST_BITS, 0):  # by the bit table, by a join
        assert collections.Counter((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(table, most_bits=most_bits).collect()) == want
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_runs_by_neighbours_equal_all_pairs():
    """Few words, so that suffixes share much to the right and differ to the left in all ways."""
    rnd = np.random.default_rng(11)
    size, least, spread = suffix_dedup.SPREAD - 1, suffix_dedup.LEAST, suffix_dedup.SPREAD
    for _ in range(60):
        n = int(rnd.integers(1, 30))
        base = rnd.integers(1, 3, size=(2, size + least)).astype(np.uint64)
        words = base[rnd.integers(2, size=n)].copy()
        for row in words:
            for at in rnd.integers(size + least, size=rnd.integers(3)):
                row[at] = 9
        ahead, behind = rnd.choice([least, least, 40, 19], size=n), rnd.choice([size, size, 12, 0], size=n)
        col = np.arange(size + least)
        words[(col >= size + ahead[:, None]) | (col < size - behind[:, None])] = 0
        begins = np.arange(spread)
        there = (begins >= size - behind[:, None]) & (begins + least <= size + ahead[:, None])
        h, places = rnd.integers(2, size=n), rnd.choice([1, 1, 2], size=n)
        got = suffix_dedup.repeated_runs(h, words, ahead, behind, there, places)
        for i in range(n):
            for at in range(spread):
                same = sum(int(places[j]) for j in range(n) if there[j, at] and h[j] == h[i] and (words[j, at : at + least] == words[i, at : at + least]).all())
                assert got[i, at] == (there[i, at] and same > 1)


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 60])
def test_passages_around_a_hot_line(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rnd = random.Random(7)

    def words(n):
        return [f"w{rnd.randrange(10**9)}" for _ in range(n)]

    line, rows = words(45), []
    left = [words(5) for _ in range(6)]  # each before two lines
    right = words(5)
    for i in range(420):
        after = right + words(40) if i in (3, 77) else words(45)
        before = left[i // 2 % 6] if i % 70 in (0, 1) else words(5)
        rows.append((i, " ".join(words(30) + before + line + after)))
    far = words(20)  # a longer match to the left of what a neighbour confirms
    rows += [(900, " ".join(far + line + right)), (901, " ".join(far + line + words(30))), (902, " ".join(far + line + words(30))), (902, rows[5][1]), (None, rows[5][1])]
    table = docs(spark, rows)
    got = collections.Counter((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(table).collect())
    want = brute_passages(rows)
    assert len(want) > 15 and got == want


# 7 toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(table, labels)
    rows = toxicity.score(table, model).join(labels, "doc_id").filter(toxicity.held_out()).select("score", "toxic").toPandas()
    rank, y = rows.score.rank(), rows.toxic == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.8 and rows.score.between(0, 1).all()
    odd = docs(spark, [(1, None), (2, ""), (3, LONG), (None, "you idiot clown moron scum, worthless trash")])
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert got[1] == got[2] and got[None] > 0.3
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and None not in {r.doc_id for r in kept.select("doc_id").collect()}


def test_toxicity_without_labels(spark, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, [(1, "a")]), none)
    assert [r.score for r in toxicity.score(docs(spark, [(1, "a")]), model).collect()] == [0.0]
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_keeps_every_counted_gram(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, " ".join("".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(40)) + " vile" * (i % 2)) for i in range(400)]
    table, labels = docs(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")

    def run():
        model = toxicity.fit(table, labels)
        scores = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
        return model, scores, {r.doc_id for r in toxicity.keep_clean(table, model).collect()}

    _, want, kept = run()
    assert len({round(x, 6) for x in want.values()}) > 100
    for slots, held in ((65_537, 10**6), (65_537, 3000), (65_537, 0)):  # a slot has room for what 65,537 leaves of a key
        monkeypatch.setattr(toxicity, "SLOTS", slots)
        monkeypatch.setattr(toxicity, "CONTEXT_SLOTS", 503)
        monkeypatch.setattr(toxicity, "HELD", held)
        model, got, left = run()
        assert (model.asked is None) == (held == 10**6) and len(model.shared.value.held[0]) <= held
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want) and left == kept


def plain_features(text, ratio):
    raw = b" " * 6 + (text or b"").lower()
    x = [ratio(int.from_bytes(raw[i - 5 : i + 1])) for i in range(6, len(raw))]
    sums = np.concatenate([[0], np.cumsum(x)])
    best = [max(sums[w:] - sums[:-w]) / w if len(x) > w else sums[-1] / w for w in toxicity.STRETCHES]
    return [sums[-1] / max(len(x), 1), *best, np.log1p(len(x))]


@pytest.mark.parametrize("piece", [toxicity.PIECE, 100])
def test_features_against_plain_loops(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    rng = random.Random(1)
    texts = [b"", b"ab", b"Some longer text " * 20, None, bytes(rng.choice(b"abc ") for _ in range(1000)), b"x" * 64]
    grams, _ = toxicity._grams([b" " * 6 + (t or b"") for t in texts])
    table = {int(g): rng.randrange(-(1 << 22), 1 << 22) for g in grams}
    rest, ratio = np.full(toxicity.SLOTS, 0xFFFFFFFF, np.uint32), np.zeros(toxicity.SLOTS, np.int32)
    for g, x in table.items():
        rest[g % toxicity.SLOTS], ratio[g % toxicity.SLOTS] = g // toxicity.SLOTS, x
    none = np.full(toxicity.CONTEXT_SLOTS, 0xFFFFFFFF, np.uint32), np.zeros(toxicity.CONTEXT_SLOTS, np.int32)
    tables = toxicity.Tables((rest, ratio), none)
    got = tables.features(texts)
    for t, f in zip(texts, got):
        assert np.allclose(f, plain_features(t, lambda g: float(ratio[g % toxicity.SLOTS]) / toxicity.UNIT), atol=1e-9)
        assert (tables.features([t]) == f).all()


def plain_kneser_ney(rows):
    """Log ratio of a 6-gram or, where it was not counted, of its context, from the definition."""
    d, chain = toxicity.DISCOUNT, (6, 4, 2)
    count = [collections.Counter(), collections.Counter()]
    for text, c in rows:
        raw = b" " * 6 + text.lower()
        count[c].update(raw[i - 5 : i + 1] for i in range(6, len(raw)))
    types = {6: set(count[0]) | set(count[1])}
    for n, m in ((4, 6), (2, 4)):
        types[n] = {g[-n:] for g in types[m]}
    continued = {n: collections.Counter(g[-n:] for g in types[m]) for n, m in ((4, 6), (2, 4))}

    def lower(g, n):
        if n == 0:
            return 1 / 256
        same = [x for x in types[n] if x[:-1] == g[:-1]]
        total = sum(continued[n][x] for x in same)
        return max(continued[n][g] - d, 0) / total + d * len(same) / total * lower(g[2:], chain[chain.index(n) + 1] if n > 2 else 0)

    def ratio(g):
        p, freed = [], []
        for c in (0, 1):
            same = [x for x in count[c] if x[:-1] == g[:-1]]
            total = sum(count[c][x] for x in same)
            freed.append(d * len(same) / total if total else 1.0)
            p.append((max(count[c][g] - d, 0) / total if total else 0.0) + freed[-1] * (lower(g[2:], 4) if g in types[6] else 0))
        return np.log(p[1] / p[0]) if g in types[6] else np.log(freed[1] / freed[0])

    return ratio


def test_kneser_ney_against_plain_loops(spark):
    rows = [(b"The cat sat on the mat", 0), (b"you vile cat", 1), (b"on the mat you sat", 0), (b"vile vile mat", 1), (b"Cat", 0)]
    counts = spark.createDataFrame([(t, c) for t, c in rows], "text binary, toxic int").repartition(2).mapInArrow(toxicity._count, "g long, c0 long, c1 long")
    grams, contexts = toxicity.kneser_ney(counts.groupBy("g").agg(toxicity.F.sum("c0").alias("c0"), toxicity.F.sum("c1").alias("c1")))
    want = plain_kneser_ney(rows)
    got = grams.collect()
    assert len(got) > 40
    for r in got:
        assert abs(r.ratio / toxicity.UNIT - want(int(r.g).to_bytes(6))) < 1e-5
    for r in contexts.collect():
        assert abs(r.ratio / toxicity.UNIT - want(int(r.h).to_bytes(5) + b"\xff")) < 1e-5


def test_a_score_depends_on_its_text_alone(spark, real):
    model = toxicity.fit(real, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))
    score = model.scorer()
    texts = [(r.text or "").encode() for r in real.collect()]
    assert list(score(texts)) == [score([t])[0] for t in texts]
    long = b"you vile scum " + b"ordinary words of any kind " * 400_000
    assert score([b"a", long, None])[1] == score([long])[0]


# 8 exact duplicates


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(spark, real, empty, bits):
    rows = [(1, "a  b"), (0, "a\tb"), (5, None), (4, ""), (6, " "), (7, "\n"), (None, "a b"), (9, LONG), (8, LONG + " "), (8, LONG), (3, "same"), (3, "same")]
    table = real.unionByName(docs(spark, [(None if i is None else i + 70_000, t) for i, t in rows], False))
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(table, key_bits=bits).collect())
    groups = collections.defaultdict(list)
    for r in table.collect():
        groups[re.sub(r"[ \t\n\v\f\r]+", " ", r.text or "")].append(r.doc_id)
    want, kept = collections.Counter(), 0
    for t, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        kept += 1
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            want[i, first, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want and exact_dedup.exact_dedup(empty, key_bits=bits).count() == 0


def test_cuts_are_local():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8)
    find = lambda x: exact_dedup.cuts(np.flatnonzero((exact_dedup.gear(x) & np.uint32((exact_dedup.MEAN - 1) << 20)) == 0) + 1, 0, len(x))
    whole, shifted = find(data), find(np.concatenate([rng.integers(0, 256, 777, dtype=np.uint8), data]))
    assert len({c + 777 for c in whole} & set(shifted)) > 0.9 * len(whole)
    assert max(np.diff([0, *whole])) <= exact_dedup.MOST


# 9 personal data

BASE = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")), ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))]


def brute_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d))))
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and not (13 <= len(d) <= 19 and total % 10 == 0)) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_equals_brute_force(spark, real, tmp_path):
    rnd = random.Random(6)
    alphabet = list("0123456789") * 3 + list(" -.+()@abé%😀")
    rows = [(90_001, None), (90_002, ""), (90_003, "a@b.c+d@e.f x@y..z a@b.c."), (90_004, "1.2.3.4.5.6.7.8 0001.002.3.255 256.1.1.1 1.2.3.00000 0.0.0.0"), (90_005, "é😀 4111-1111-1111-1111 +1 (017) 555-7713. +12"), (90_006, "1.1.1.1 " * 500)]
    rows += [(91_000 + i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))) for i in range(1500)]
    real.unionByName(docs(spark, rows, False)).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs(spark, rows, False).collect()}
    for r in pii.op9_pii(spark, str(tmp_path)).collect():
        if r.doc_id in texts:
            base = brute_spans(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r.doc_id]
            assert set(base) <= set(filter(None, r.spans.split(",")))
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]


def test_pii_very_long_texts(spark):
    rows = [(1, "a" * 200_000 + "@b.c"), (2, "1" * 200_000), (3, "@" * 200_000), (4, "1 " * 200_000), (5, "a@b" + ".c" * 50_000), (6, "+" * 100_000), (7, "(((" * 50_000)]
    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii.find_pii(docs(spark, rows)).collect()}
    assert got[1] == [(0, 0, 200_004)] and got[5] == [(0, 0, 100_003)] and not any(got[i] for i in (2, 3, 4, 6, 7))


def test_pii_added_spans(spark):
    rows = [(1, "call (415) 555-0132 now"), (2, "write to ana.lopez (at) example (dot) com today"), (3, "order 20240131120000 is done"), (4, "mail a@b.com"), (5, "price @ 3.50 and more")]
    got = {r.doc_id: [(pii.KINDS[x.k], x.start, x.end) for x in r.added] for r in pii.find_pii(docs(spark, rows)).collect()}
    assert got[1] == [("phone", 5, 19)] and got[2] and got[2][0][0] == "email" and not got[3] and not got[4] and not got[5]


def test_pii_score_equals_mllib_and_holds_out(spark):
    """Of candidates whose texts neither trees nor thresholds have seen."""
    rows = pii.parts(pii.labelled_candidates(spark)).coalesce(1).persist()
    model = pii.fit(rows)
    sql, thresholds = pii.train(pii.labelled_candidates(spark))
    got = model.transform(rows).select("kind", "label", "part", "probability", pii.F.expr(pii.score_sql(model)).alias("mine"), pii.F.expr(sql).alias("score")).collect()
    assert all(abs(r.probability[1] - r.mine) < 1e-9 for r in got)
    assert not {r.text for r in rows.filter("part = 1").select("text").collect()} & {r.text for r in rows.filter("part <> 1").select("text").collect()}
    for k, name in enumerate(pii.KINDS):
        own = [r for r in got if r.kind == k and r.part == 1]
        found = [r for r in own if r.score >= thresholds[k]]
        precision, recall = sum(r.label for r in found) / len(found), sum(r.label for r in found) / sum(r.label for r in own)
        print(name, len(own), "precision", precision, "recall", recall)
        assert precision >= 0.9 and recall >= 0.9


def test_pii_sweep_equals_brute_force(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for i in range(400):
        base, at = [], 0
        for _ in range(rnd.randrange(4)):
            at += rnd.randrange(12)
            base.append((rnd.randrange(4), at, at + 1 + rnd.randrange(8)))
            at = base[-1][2] if rnd.random() < 0.8 else at
        good = [(rnd.randrange(4), a, a + 1 + rnd.randrange(9), rnd.choice([0.6, 0.7, 0.8, 0.9])) for a in (rnd.randrange(40) for _ in range(rnd.randrange(7)))]
        good = sorted({(x[1]): x for x in good}.values())
        rows.append((i, base, good))
        taken = []
        for c in sorted((c for c in good if not any(b[1] < c[2] and c[1] < b[2] for b in base)), key=lambda c: (-c[3], c[1])):
            if not any(t[1] < c[2] and c[1] < t[2] for t in taken):
                taken.append(c)
        want[i] = sorted(t[:3] for t in taken)
    chain = [(0, 0, 10, 0.8), (0, 5, 15, 0.9)]
    rows.append((900, [(1, 12, 20)], chain))
    want[900] = [(0, 0, 10)]
    df = spark.createDataFrame(rows, f"i int, base array<struct<k:int,start:int,end:int>>, good array<{pii._SPAN}>")
    for r in df.select("i", pii.F.expr(pii._SWEEP).alias("added")).collect():
        assert sorted((x.k, x.start, x.end) for x in r.added) == want[r.i]


def test_pii_edges(spark, empty, tmp_path):
    assert pii.find_pii(empty).count() == 0
    rows = [(1, "call (415) 555-0132 now, a@b.com"), (1, "call (415) 555-0132 now, a@b.com"), (None, "a@b.com 01 23 45 67 89")]
    spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, spans string, base int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.spans, r.n_email, r.n_spans) for r in pii.op9_pii(spark, str(tmp_path)).collect()), key=str)
    assert got[0] == got[1] == (1, "email:25:32,phone:5:19", 1, 2) and got[2][2] == 1


# 10 sharding


def test_fisher_yates():
    assert sorted(sharding.fisher_yates(1000, 1, 2)) == list(range(1000)) and len(sharding.fisher_yates(0, 1, 2)) == 0 and list(sharding.fisher_yates(1, 1, 2)) == [0]
    first = collections.Counter(int(sharding.fisher_yates(4, 7, b)[0]) for b in range(4000))
    assert all(850 < n < 1150 for n in first.values())


def test_shards(spark, real, empty, tmp_path):
    rows = [(1, None), (1, None), (2, ""), (None, LONG), (3, "a"), (4, "a")]
    table = real.unionByName(docs(spark, rows, False)).withColumn("shard", sharding.F.lit("mine"))
    one = sharding.shard_documents(table, 7, f"{tmp_path}/a", bucket_bytes=20_000)
    two = sharding.shard_documents(table.repartition(5), 7, f"{tmp_path}/b", bucket_bytes=20_000, most=5)
    key = lambda df: sorted((str(r.doc_id), r.text or "", r._shard, r.slot) for r in df.collect())
    assert [x[2:] for x in key(one)] == [x[2:] for x in key(two)]
    shards = collections.defaultdict(list)
    for r in one.collect():
        shards[r._shard].append(r.slot)
    assert len(shards) == 7 and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert sharding.shard_documents(empty, 3, f"{tmp_path}/c").count() == 0


def test_shards_equal_plain_shuffles(spark, tmp_path):
    """Buckets, their order, Fisher-Yates, slots and shards worked out row by row; a very long text counts into the buckets."""
    rnd = random.Random(4)
    rows = [(rnd.randrange(10**6), "w " * rnd.randrange(400)) for _ in range(300)] + [(7, None), (None, "x"), (8, "long " * 40_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    size, seed, shards = 30_000, 5, 6
    buckets = max(sharding.LEAST_BUCKETS, -(-sum(len((t or "").encode()) for _, t in rows) // size))
    hashed = table.select("doc_id", "text", *(sharding.F.xxhash64(sharding.F.lit(seed + i), "doc_id", sharding.F.crc32(sharding.F.coalesce("text", sharding.F.lit("")).cast("binary"))).alias(f"h{i}") for i in (0, 1))).collect()
    place = []
    for b in range(buckets):
        own = sorted((r for r in hashed if r.h0 % buckets == b), key=lambda r: (r.h1, r.doc_id is not None, r.doc_id or 0))
        order, random_ = list(range(len(own))), np.random.Generator(np.random.PCG64([seed, b]))
        picks = random_.integers(0, np.arange(len(own), 0, -1)) if own else []
        for i, j in zip(range(len(own) - 1, 0, -1), picks):
            order[i], order[j] = order[j], order[i]
        place += [own[i] for i in order]
    want = collections.Counter()
    for at, r in enumerate(place):
        shard = at * shards // len(rows)
        want[r.doc_id, r.text, shard, at - min(k for k in range(len(rows)) if k * shards // len(rows) == shard)] += 1
    got = sharding.shard_documents(table.repartition(3), shards, f"{tmp_path}/p", seed=seed, bucket_bytes=size)
    assert collections.Counter((r.doc_id, r.text, r.shard, r.slot) for r in got.collect()) == want
