"""Chat formatting (3), URL filters (4), license scans (9) and embedding near-dedup (7) against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from viewgrade.llm import chat, embedding_dedup, license_scan, url_filter

SPACE = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark):
    texts = ["", None, "</s>[INST] ok [/INST]", "&lt;|turn|>&amp;", "<|turn|>user<|text|>x<|end|>", "<<SYS>> a <</SYS>>", "&nul;\0é\n😀", "[[INST]]<<s>", "<|" * 5]
    roles = ["user", "assistant", None, "sys<|end|>tem"]
    rows = [(c, t, roles[(c + t) % 4], texts[(c * 3 + t) % len(texts)]) for c in range(9) for t in range(c)]
    rows += [(3, 0, "user", "again"), (3, 0, "user", "again"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_at", F.lit("clash"))
    got = {r.conv_id: r for r in chat.op3(df).collect()}
    want = {}
    for c, t, r, x in [*rows, (-7, 0, "user", texts[2]), (-7, 1, "assistant", texts[2])]:
        want.setdefault(c, []).append((t, r or "", x or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        if c != 3:  # ties are ordered by the escaped text
            turns.sort(key=lambda x: x[0] if x[0] is not None else -1)
            assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        if c != 3:
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    formatted = chat.chat_format(chat.text_parts(df)).collect()
    for r in formatted:
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|end|>") == len(want[r.conv_id])
        assert not re.search(r"</?s>|\[/?INST\]", r.formatted)
    assert chat.op3(df.limit(0)).count() == 1


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "look: ", None, None), ("image", None, "a.png", 2), ("text", " and ", None, None), ("audio", None, "b.wav", 3), ("document", None, "c.pdf", None), ("film", None, "d", 9)]), (1, 1, "assistant", [(None, "fine", None, None)]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.read_back(chat.chat_format(df)).collect()}
    assert got[1].formatted == "<|turn|>user<|text|>look: <|part:image|> and <|part:audio|><|part:document|><|part:film|><|end|><|turn|>assistant<|text|>fine<|end|>"
    assert [tuple(a) for a in got[1].attachments] == [("image", "a.png", 512), ("audio", "b.wav", 75), ("document", "c.pdf", 512), ("film", "d", 0)]
    assert got[1].expanded_tokens == 1099 and list(got[1].loss_texts) == ["fine"]
    assert got[2].formatted == "<|turn|>user<|text|><|end|>" and not got[2].attachments
    assert [tuple(p) for p in got[1].turns[0].parts] == [("text", "look: "), ("image", None), ("text", " and "), ("audio", None), ("document", None), ("film", None)]


def test_chat_types_form_no_mark(spark):
    """Every control name and string as a part's type, and texts that look like placeholders."""
    names = ["turn", "head", "end", "part:image", "|>", "<|end|>", "a|>b<|turn|>", "image|><|end", "", "&vert;", "</s>", "[INST]", "x:y", "im|age"]
    rows = [(i, 0, role, [("text", f"<|part:{n}|>", None, None), (n, None, "ref", 1), (None, f"after &vert; |> {n}", None, None), (n, "lost", None, None)]) for i, n in enumerate(names) for role in ["assistant"]]
    rows += [(100, 0, "assistant", [("text", "é " * 400_000 + "<|end|>", None, None), ("image", None, "r", 1)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.read_back(chat.chat_format(df)).collect()}
    for i, n in enumerate(names):
        r = got[i]
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|text|>") == r.formatted.count("<|end|>") == 1 and not re.search(r"</?s>|\[/?INST\]", r.formatted)
        assert [tuple(p) for p in r.turns[0].parts] == [("text", f"<|part:{n}|>"), (n, None), ("text", f"after &vert; |> {n}"), (n, None)]
        assert [(a.type, a.ref) for a in r.attachments] == [(n, "ref"), (n, None)] and list(r.loss_texts) == [f"<|part:{n}|>", f"after &vert; |> {n}"]
    assert [tuple(p) for p in got[100].turns[0].parts] == [("text", "é " * 400_000 + "<|end|>"), ("image", None)] and len(got[100].loss_texts[0]) == 800_007


LISTED = [*url_filter.LISTED, "http://deep.example.org/a/b"]


def verdict(url, listed=LISTED):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for v, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    plain = re.sub(r"\.+\Z", "", re.sub(r":[0-9]*\Z", "", host.split("@")[-1]))
    clean = [x for x in path.split("/") if x not in ("", ".")]
    listed = host and any((plain == h or plain.endswith("." + h)) and clean[: p.count("/")] == p.split("/")[1:] for h, p in (re.match("http://([^/]*?)((?:/[^/]+)*)/?$", x).groups() for x in listed))
    return host, path, best and best[0], best[1] if best else "block" if listed else "allow"


def test_url_verdicts(spark):
    urls = [None, "", "nothing", "http://", "http://a.com", "HTTP://A.COM/x?y", "https://example.com/en/1", "https://sub.www.example.com/en/1#f", "https://badexample.com/en/", "https://x.net/fr/q", "https://x.net/en/", "ftp://net/es/", "http://spam-farm.example.org/a", "http://w.spam-farm.example.net/", "http://spam-farm.example.org", "x://a?b://c.net/es/", "http://É.com/é\n/ü", "http://.com/", "http://a..net/fr/"]
    urls += ["http://spam-farm.example.org:8080/a", "http://u@spam-farm.example.org/a", "http://spam-farm.example.org./a", "http://a:b@x.SPAM-farm.example.org.:80", "http://spam-farm.example.org.uk/", "http://deep.example.org/a/b/c", "http://deep.example.org//a/././b?x", "http://deep.example.org/a", "http://deep.example.org/A/b", "http://w.deep.example.org:1/a//b", "http://@/", "http://:80/", "http://deep.example.org/a/bc", "http://deep.example.org/a/b/", "http://deep.example.org/a/b/./", "http://x.deep.example.org/a/./b/.", "http://deep.example.org/a/b\n", "http://deep.example.org./a/b/" + "c/" * 50_000, "http://" + "x." * 20_000 + "deep.example.org/a/b"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[5:8])] + [(None, urls[7])], "page_id long, url string").withColumn("key", F.lit(1))
    listed = spark.createDataFrame([(x,) for x in [*url_filter.LISTED, "HTTP://u@deep.example.org:80//a/./b/", "no url", "http://", "http://@:1/", None]], "url string")
    got = url_filter.url_verdicts(df, url_filter.entries_of(spark, listed=listed)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter((r.page_id, *tuple(r)[1:]) for r in got) == Counter((i, *verdict(u)) for i, u in [*enumerate(urls + urls[5:8]), (None, urls[7])])
    assert url_filter.op4(df.limit(0)).count() == 0
    names = ["host", "path", "_head", "_rule", "_listed", "rule", "verdict", "block", "mask", "word", "segment", "host_in", "key"]
    odd = df.select("page_id", "url", *[F.lit(c.upper()).alias(c) for c in names])
    clash = url_filter.url_verdicts(odd, url_filter.entries_of(spark, listed=listed))
    rows = clash.collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows) == Counter(map(tuple, got))
    assert {(r.path_in, r.host_in, r.host_in_in, r.verdict_in, r._head, r._rule, r._listed, r.segment) for r in rows} == {("PATH", "HOST_IN", "HOST", "VERDICT", "_HEAD", "_RULE", "_LISTED", "SEGMENT")}
    assert url_filter.url_verdicts(df, url_filter.entries_of(spark).limit(0)).where("verdict <> 'allow'").count() == 0


def test_a_list_of_pages(spark, tmp_path):
    """The registered query against brute force and its SQL; its filter lets few keys through that the list doesn't hold."""
    urls = [f"{'http' if i % 3 else 'HTTPS'}://{'www.' * (i % 4 == 1)}h{i % 70}.{('org', 'net', 'com', 'info')[i % 4]}{':80' * (i % 5 == 2)}/{'de' if i % 7 else 'fr'}/{'./' * (i % 6 == 1)}{i % 400}{('', '/', '//x', '?q', '#f')[i % 5]}" for i in (n * 2654435761 % 2**32 >> 8 for n in range(6000))]
    pages = spark.createDataFrame([*enumerate(urls), (6000, None), (6020, "x"), (6040, "http:///a"), (6041, "http://b./")], "page_id long, url string")
    rows = pages.collect()
    listed = {"http://" + plain for plain in (("/".join([re.sub(r"\.+\Z", "", re.sub(r":[0-9]*\Z", "", h)), *(x for x in p.split("/") if x not in ("", "."))])) for h, p in (verdict(r.url, [])[:2] for r in rows if r.page_id % 20 == 0)) if not plain.startswith("/") and plain} | {x.rstrip("/") for x in url_filter.LISTED}
    want = Counter((r.page_id, *verdict(r.url, sorted(listed))) for r in rows)
    got = url_filter.op4(pages).collect()
    assert Counter(map(tuple, got)) == want and 300 < len(listed) and 300 < sum(r.verdict == "block" and r.rule is None for r in got) < 3000
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
        assert Counter(db.execute(url_filter.ORACLE).fetchall()) == want


def test_a_large_list_from_a_table(spark):
    listed = spark.range(30_000).select(F.concat(F.lit("https://h"), "id", F.lit(".org/p/")).alias("url"))
    pages = spark.range(60_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".org:443//p/./q")).alias("url"))
    got = url_filter.url_verdicts(pages, url_filter.entries_of(spark, listed=listed)).groupBy("verdict").agg(F.count("*").alias("n"), F.min("page_id").alias("least"), F.max("page_id").alias("most")).collect()
    assert {(r.verdict, r.n, r.least, r.most) for r in got} == {("block", 30_000, 0, 29_999), ("allow", 30_000, 30_000, 59_999)}


def test_bloom_has_no_false_negatives_and_few_hits(spark):
    keys = spark.range(2000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("key"))
    blocks = 2000 * url_filter.BITS_PER_KEY // 64
    asked = spark.range(4000).select("id", F.concat(F.lit("h"), "id", F.lit(".org/")).alias("key"))
    n = url_filter.passed_by(asked, url_filter.bloom(keys, blocks), blocks).agg(F.count_if(F.col("id") < 2000), F.count_if(F.col("id") >= 2000)).first()
    assert n[0] == 2000 and n[1] < 100


def scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for label, phrase in license_scan.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    texts = [None, "", "Released Under the MIT-License.", "cc by NC cc by nc", "Apache License, Version 2.0; under the mit license under the mit license", "under the mit", "license under the é mit license", "x " * 900 + "CC-BY-NC"]
    texts += ["GNU General Public License, version 3", "gnu general public license as published by the Free Software Foundation; either version 3", "gnu general public license as published version 3", "gnu general public license version 30",
              "Permission is hereby granted, free of charge, to any person obtaining a copy of this software (the Software), to deal in the Software without restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software a b c d e to deal in the software without restriction"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[2])], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.op9(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == scan(t), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert [got[i].labels for i in range(8, 14)] == ["gpl-3", "gpl-3", "", "", "mit-opening", ""]
    assert got[None].labels == "mit" and license_scan.op9(df.limit(0)).count() == 0


def filled(template, rng, change=None):
    """A text of a template: optional regions there or not, other words for replaceable ones, odd case and marks; ``change``
    replaces one mandatory word."""
    out = []
    for region in re.findall(r"\[\[.*?\]\]|\{\{\d+-\d+\}\}|(?:(?!\[\[|\{\{).)+", template, re.S):
        if region.startswith("{{"):
            low, high = map(int, re.findall(r"\d+", region))
            out += [(w, False) for w in ["Jane", "Doe", "é", "Ltd"] * 3][: int(rng.integers(low, high + 1))]
        else:
            words, there = region.strip("[]").split(), not region.startswith("[[")
            out += [(w, there) for w in words] if there or rng.random() < 0.5 else []
    if change is not None:
        at = [i for i, (_, there) in enumerate(out) if there][change]
        out[at] = ("altered", True)
    return "".join((w.upper() if rng.random() < 0.3 else w) + str(rng.choice([" ", ", ", ".\n", ' "', "-"])) for w, _ in out)


def test_whole_licenses(spark):
    """A licence has its label if all mandatory words are there, and not if any one of them differs."""
    rng, rows, want = np.random.default_rng(4), [], {}
    for label, template in license_scan.LICENSES:
        mandatory = len(re.sub(r"\[\[.*?\]\]|\{\{.*?\}\}", " ", template, flags=re.S).split())
        for change in [None] * 4 + rng.integers(0, mandatory, 12).tolist() + [mandatory - 1]:
            want[len(rows)] = (label, change is None)
            rows.append((len(rows), "Copyright 2020 someone.\n" + filled(template, rng, change) + " the end"))
    rows += [(1000, " ".join(["word"] * 300_000) + " " + filled(license_scan.LICENSES[3][1], rng))]
    odd = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(7).alias("labels"), F.lit(8).alias("n_words"), F.lit(9).alias("score"))
    got = {r.doc_id: r for r in license_scan.op9(odd).collect()}
    for i, (label, whole) in want.items():
        found = set(got[i].labels.split(","))
        assert (label in found) == whole, (i, label, found)
        assert not whole or got[i].score > 0.9
        assert not whole or label != "bsd-2" or "bsd-3" not in found
    assert "mit" in got[1000].labels.split(",") and got[1000].n_words > 300_000 and 0 < got[1000].score < 0.01


def brute_score(text):
    """Share of the words under base phrases and templates, every template being tried as a regular expression."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    joined, at = "".join(w + " " for w in words), np.cumsum([0, *[len(w) + 1 for w in words]])
    labels, under = set(), np.zeros(len(words), bool)
    for label, template in [*license_scan.BASE, *license_scan.TEMPLATES]:
        parts = re.findall(r"\[\[.*?\]\]|\{\{\d+-\d+\}\}|(?:(?!\[\[|\{\{).)+", template, re.S)
        shape = "".join(f"(?:[^ ]+ ){{{p[2:-2].replace('-', ',')}}}?" if p.startswith("{{") else f"(?:{''.join(w + ' ' for w in p.strip('[]').split())})?" if p.startswith("[[") else "".join(re.escape(w) + " " for w in p.split()) for p in parts)
        for i in range(len(words)):
            if m := re.compile(shape).match(joined, int(at[i])):
                labels.add(label)
                under[i : int(np.searchsorted(at, m.end()))] = True
    return ",".join(sorted(labels)), under.mean() if len(words) else 0.0


def test_labels_and_score_against_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary = sorted({w for _, t in license_scan.NOTICES + license_scan.OPENINGS for w in re.sub(r"[\[\]{}]", " ", t).split()})
    texts = []
    for _ in range(150):
        some = [filled(license_scan.TEMPLATES[i][1], rng, None if rng.random() < 0.7 else 0) for i in rng.integers(0, len(license_scan.TEMPLATES), 2)]
        texts.append(" ".join([*rng.choice(vocabulary, 5), some[0], *rng.choice(vocabulary, 3), some[1]]))
    got = {r.doc_id: r for r in license_scan.op9(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        labels, score = brute_score(t)
        assert got[i].labels == labels and abs(got[i].score - score) < 1e-12, t


def test_embedding_classes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 16))
    rows = []
    for i, v in enumerate(x):
        rows.append(v)
        for _ in range(i % 7):
            rows.append(v + rng.normal(size=16) * np.linalg.norm(v) / 4 * rng.uniform(0.2, 0.7))
        rows += [v] * (i % 3)
    rows += [x[0] * 2.0] * 3 + [np.zeros(16), np.full(16, np.nan), np.append(x[0][:15], np.inf), x[0][:7]]
    vectors = [(i, [float(y) for y in v]) for i, v in enumerate(rows)] + [(9001, None), (9002, [None] * 16), (None, [float(y) for y in x[3]])]
    got = {r.vec_id: r for r in embedding_dedup.op7(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(vectors)
    ok = {i: np.array(v) for i, v in vectors if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    ids = list(unit)
    m = np.array([unit[i] for i in ids])
    close = (m @ m.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    found = sum(got[i].n_links for i in ids)
    assert 0.9 * close.sum() <= found <= close.sum()
    assert all(got[i].n_links <= n for i, n in zip(ids, close.sum(1), strict=True))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in vectors if i is not None and i not in ok)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in np.argwhere(close):
        parent[root(ids[a])] = root(ids[b])
    same = sum(root(i) == root(got[i].component_id) for i in ids if i is not None and got[i].component_id is not None)
    assert same == len([i for i in ids if i is not None and got[i].component_id is not None])
    assert embedding_dedup.op7(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
