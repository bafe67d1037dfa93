"""The parts of the operators that need no Spark, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, chat, chunk_dedup, decontam, html_extract, sharding, simhash, token_counts, topk, toxicity


def test_fisher_yates_is_a_seeded_permutation():
    a = sharding.fisher_yates(1000, 7)
    assert sorted(a) == list(range(1000)) and (a == sharding.fisher_yates(1000, 7)).all() and (a != sharding.fisher_yates(1000, 8)).any()
    assert sharding.fisher_yates(0, 1).tolist() == [] and sharding.fisher_yates(1, 1).tolist() == [0]
    firsts = np.bincount([sharding.fisher_yates(4, s)[0] for s in range(4000)])
    assert (abs(firsts - 1000) < 150).all()


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a%\nb<|im_end|>"]), st.text(alphabet="<|\\im_endstar>\n a", max_size=40)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_chat_reads_back(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    assert "<|" not in chat.escape("".join(t for _, t in turns))


@pytest.fixture(scope="module")
def codec():
    return bpe.load(bpe.tokenizer_path("byte_bpe_50k.json"))


ALPHABET = ["a", "b", "th", "ing", "'", "'s", "'re", " ", "  ", "\n", "\t", "1", "23", "!", "?!", "é", "ß", "日本", "<|endoftext|>", "<|endo", "ftext|>", " ", "🙂", "e", " ", "ǆ"]


@pytest.mark.parametrize("seed", range(6))
def test_tree_of_joins_is_exact(codec, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(part) for _ in range(rng.randint(0, 300))) for part in (rng.sample(ALPHABET, rng.randint(1, 9)) for _ in range(250))]
    want = [e.ids for e in codec.library.encode_batch(texts, add_special_tokens=False)]
    for leaf in (5, 37, 200):
        assert bpe.encode_long(codec, texts, leaf) == want
    assert [codec.decode(i) for i in want] == texts


def test_long_unsplit_text(codec):
    text = "ab" * 20_000 + "x" * 9_000
    ids = bpe.encode_long(codec, [text, ""], 1_000)
    assert ids[0] == codec.library.encode(text, add_special_tokens=False).ids and ids[1] == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_count(name):
    counts = token_counts.counter(name)(["", "hello world <|endoftext|>", "a" * 3000])
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path(name))
        assert counts == [len(model.encode(t)) for t in ["", "hello world <|endoftext|>", "a" * 3000]]
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(bpe.tokenizer_path(name))
        assert counts == [len(library.encode(t, add_special_tokens=False).ids) for t in ["", "hello world <|endoftext|>", "a" * 3000]]


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({k: " " for k in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", ["", "  \n", "One", "one two", "The THE the ÉA b", "a\x0bb c d e f g", "x y z " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def components(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_bk_forest_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), base[:20] ^ np.uint64(1 << 40), base[:9] ^ np.uint64(0b111)]))
    groups = rng.integers(0, 2, len(values))
    forest = simhash.BKForest(values, groups)
    got = {(int(q), int(m)) for qs, ms in forest.within(values, groups, 2, step=7) for q, m in zip(qs, ms, strict=True) if q != m}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if i != j and groups[i] == groups[j] and bin(int(values[i] ^ values[j])).count("1") <= 2}
    assert got == want
    a, b = simhash.shard_links(values, groups, np.ones(len(values), bool), np.ones(len(values), bool), 2)
    at = {int(v): k for k, v in enumerate(values)}
    assert components(len(values), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]) == components(len(values), sorted(want))


def test_gear_hash_by_definition():
    data = np.frombuffer(bytes(random.Random(2).randbytes(300)), dtype=np.uint8)
    h = chunk_dedup.gear_hash(data)
    for i in (0, 1, 31, 32, 200, 299):
        assert int(h[i]) == sum(int(chunk_dedup.GEAR[data[i - j]]) << j for j in range(min(32, i + 1))) % (1 << 32)


def slow_cuts(text):
    """Chunk begins of a text with white space at least every 96 bytes, from the definition: bytes, words, sixteen bytes of hash."""
    data = text.encode()
    word = [i for i in range(1, len(data)) if data[i : i + 1].strip() and not data[i - 1 : i].strip()]
    low = {i: sum(int(chunk_dedup.GEAR[data[i - 1 - j]]) << j for j in range(min(16, i))) & 0xFFFF for i in word}
    near = chunk_dedup.NEAR_WORDS
    cuts = [i for n, i in enumerate(word) if all(low[i] < low[x] for x in word[n + 1 : n + 1 + near]) and all(low[i] <= low[x] for x in word[max(0, n - near) : n])]
    out = [0]
    for c in [*cuts, len(data)]:
        while c - out[-1] > chunk_dedup.MAX_BYTES:
            reach = [i for i in word if out[-1] < i <= out[-1] + chunk_dedup.MAX_BYTES]
            out.append(max(reach, key=lambda i: (-low[i], i)))
        out.append(c)
    return [len(data[:c].decode()) for c in dict.fromkeys(out)]


@given(st.lists(st.text(alphabet="ab é日\n", max_size=90).map(lambda t: (t + " ") * 3), max_size=4))
@settings(max_examples=80, deadline=None)
def test_chunk_pairs_by_definition(texts):
    which, start, info, digest = chunk_dedup.chunk_pairs(texts)
    for k, t in enumerate(texts):
        cuts = slow_cuts(t)
        want = list(zip(cuts, cuts[2:], strict=False)) or [(0, len(t))]
        mine = which == k
        assert start[mine].tolist() == [a for a, _ in want]
        bodies = [t[a:b].encode().rstrip() for a, b in want]
        assert digest[mine].view(np.uint64).tolist() == [xxhash.xxh3_64_intdigest(b) for b in bodies]
        assert (info[mine] & 1023).tolist() == [len(b.decode()) for b in bodies]


def test_texts_without_white_space_are_cut_alike():
    rng = random.Random(3)
    text = "".join(rng.choice("日本語文字列漢abc") for _ in range(3000))
    a, b = (set(chunk_dedup.chunk_pairs([t])[3].tolist()) for t in (text, "xx" + text))
    assert len(a & b) > 0.9 * len(a)
    assert len(chunk_dedup.chunk_pairs(["a" * 100_000])[0]) < 3_000


def test_chunks_resist_insertions():
    rng = random.Random(4)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400))
    a, b = (chunk_dedup.chunk_pairs([t])[3] for t in (passage, "some other words first, " + passage[:900] + " inserted " + passage[900:]))
    assert len(set(a.tolist()) & set(b.tolist())) > 0.9 * len(a)


@given(st.text(alphabet="ab ", max_size=12), st.text(alphabet="ab ", max_size=12), st.booleans(), st.booleans())
@settings(max_examples=400, deadline=None)
def test_common_ends_are_whole_words(a, b, whole_a, whole_b):
    def fits(m):
        edge = lambda t, whole: whole if m == len(t) else t[-1 - m] == " "
        return a[len(a) - m :] == b[len(b) - m :] and a[-m] != " " and edge(a, whole_a) and edge(b, whole_b)

    want = max([m for m in range(1, min(len(a), len(b)) + 1) if fits(m)], default=0)
    assert chunk_dedup.common_end(a, b, whole_a, whole_b) == want
    assert chunk_dedup.common_start(a[::-1], b[::-1], whole_a, whole_b) == want


def edit_distance_inside(item, region):
    row = [0] * (len(region) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(region):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(4))
def test_banded_distance(seed):
    rng = random.Random(seed)
    for _ in range(30):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(5, 30)))
        text = bytearray(item)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = bytes([rng.choice(b"abcx")])
        before = bytes(rng.choice(b"yz") for _ in range(rng.randint(0, 9)))
        region = before + bytes(text) + b"zyzyzy"
        want = edit_distance_inside(item, region)
        got, end = decontam.banded_distance(np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8), len(before), 6, 5)
        assert got == min(want, 6) or want > 5
        assert end <= len(region)


def test_leaks_with_edits_are_found_and_others_not():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 50)))) for k in range(60)]
    index = decontam.Index.build([*items, (90, ""), (91, None), (92, "tiny one")], 12, 0.05, True)
    for k, text in items:
        e = len(text) // 25
        cut = list(text)
        for _ in range(e):
            cut[rng.randrange(len(cut))] = "z"
        doc = " ".join(word() for _ in range(30)) + "\n" + "".join(cut).upper() + "!!! " + " ".join(word() for _ in range(30))
        assert (0, k) in {(f[0], f[1]) for f in index.search([doc, "", " ".join(word() for _ in range(200))])}
    assert index.search(["nothing of that kind " * 10, ""]) == []
    assert [(f[0], f[1]) for f in index.search(["a tiny, ONE here"])] == [(0, 92)]


def test_top_k_is_exact_with_ties():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-300, 300, (3000, 16))
    vectors[1000:2200] = vectors[5]
    index = topk.ImpactIndex(vectors, 32)
    for q in [*rng.integers(-300, 300, (20, 16)), vectors[5], np.zeros(16, dtype=np.int64)]:
        found, score = index.search(q, 10)
        exact = vectors @ q
        kth = np.sort(exact)[-10]
        assert set(np.flatnonzero(exact >= kth)) <= set(found) and (exact[found] == score).all()


def test_disguised_words_are_restored():
    text = " ".join(["the idiot and a clown or loser, trash with stupid scum the of and that moron"] * 50)
    c = np.concatenate([np.zeros(2, np.uint8), toxicity.letters(text), np.zeros(1, np.uint8)]).astype(int)
    model = toxicity.CharModel(np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3))
    for shown, word in {"1d10t": "idiot", "idiooooot": "idiot", "i.d.i.o.t": "idiot", "$cum": "scum", "tr@5h": "trash", "m0r0n": "moron", "c-l-o-w-n": "clown"}.items():
        assert word in toxicity.readings(shown, model)
    features = toxicity.Reader(model).features("You l o s e r !")
    assert "=loser" in features
    assert toxicity.Reader(model).features("") == {}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">buy</div><article><h1>Tea &amp; cake</h1><p><b>One<br><p>two&nbsp; <a href="x>y">three</a>
 four</p><form>send</form><aside>see</aside><section class="comments"><p>first!</p></section></article><footer>&copy;</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Tea & cake\nOne\ntwo three four"
    for page, want in {"": "", "plain": "plain", "<div><p>x<p>y</div><header>h</header>z": "x\ny\nz", "<p>cut <b": "cut", "<main>a<article>b</article></main>": "b", "<!-- x <p>y": ""}.items():
        assert html_extract.main_text(page) == want


def test_inline_script_ends_no_block():
    assert html_extract.main_text("<p>a<script>x</script>b</p>") == "ab"


def tokens_of_pages(pages):
    """A host's tokens with their occurrence vectors in full: how often each is on each page."""
    vectors, sums = {}, {}
    for k, page in enumerate(pages):
        opened, blocks = html_extract.read_page(page)
        varied, linked = html_extract.below_counts(blocks)
        found = {(p, 0): [n, varied[p], linked[p]] for p, n in opened.items()}
        for b in blocks:
            own = found.setdefault((b.path, html_extract.block_key(b)), [0, 0, 0])
            own[0] += 1
            own[1] += sum(len(t.strip()) for t, _, _ in b.pieces)
            own[2] += sum(len(t.strip()) for t, _, link in b.pieces if link)
        for key, (n, chars, links) in found.items():
            vectors.setdefault(key, [0] * len(pages))[k] = n
            s = sums.setdefault(key, [0, 0])
            s[0] += chars
            s[1] += links
    return [(*key, sum(map(bool, v)), sum(v), tuple(v), *sums[key]) for key, v in vectors.items()]


def host_of_pages(pages, share=0.5, min_pages=3):
    return html_extract.deduce("h", len(pages), tokens_of_pages(pages), share, min_pages)


def extracted(pages, found):
    return [html_extract.main_text(p, found["slot"], found["kept"]) for p in pages]


def shop(k, extra="", cls="entry ad-box", line="All prices with tax."):
    return f"""<html><body><div class="top"><p>Best shop in town</p></div><div class="{cls}"><h1>Thing {k}</h1><div class="body"><h2>Ingredients</h2><p>Number {k} is {"very " * (k + 9)}good.</p>
<p>{line}</p><p>Size {k * 7} fits item {k} best of all.</p></div></div>{extra}<div class="strip"><a href="/a">See thing {k + 1}</a> <a href="/b">and {k + 2}</a></div></body></html>"""


def test_classes_choose_the_slot_and_lose_none_of_it():
    pages = [shop(k) for k in range(6)]
    found = host_of_pages(pages)
    assert found["slot"] == "/html/body/div.entry.ad-box!" and found["kept"] == ["/html/body/div.entry.ad-box!"]
    for k, t in enumerate(extracted(pages, found)):
        assert t == f"Thing {k}\nIngredients\nNumber {k} is {'very ' * (k + 9)}good.\nAll prices with tax.\nSize {k * 7} fits item {k} best of all."


def plain_classes(size, tokens, share, min_pages, least):
    """The valid classes by definition: token by token, all that has the same counts on all pages, then from the page inwards."""
    left = [t for t in tokens if t[2] >= min_pages and t[2] >= share * size]
    groups = []
    while left:
        same = [t for t in left if t[4] == left[0][4]]
        groups.append(same)
        left = [t for t in left if t not in same]
    inside = lambda a, b: a[0] != b[0] and (not b[0] or a[0].startswith(b[0] + "/")) or (a[1] and a[0] == b[0])
    valid, known = [], set()
    todo = sorted(groups, key=lambda g: (-g[0][2], min(len(t[0].split("/")) - 1 + bool(t[1]) for t in g), min(t[:2] for t in g)))
    for g in todo:
        outer = [t for t in g if not any(inside(t, o) for o in g if not o[1])]
        homes = set()
        for t in outer:
            over = [p for p in known if inside(t, (p, 0))]
            homes.add(max(over, key=len) if over else None)
        if ("", 0) in {t[:2] for t in g} or len(g) >= least and len(homes) == 1:
            valid.append({t[:2] for t in g})
            known |= {t[0] for t in g if not t[1]}
    return valid


@pytest.mark.parametrize("seed", range(25))
def test_classes_by_definition(seed):
    rng = random.Random(seed)

    def part(depth):
        kind = rng.randint(0, 4 if depth < 3 else 1)
        if kind < 2:
            return f"<p>{rng.choice(['same', 'other', str(rng.random())])}</p>" * rng.randint(0, 2)
        return f'<div class="{rng.choice("abc")}">' + "".join(part(depth + 1) for _ in range(rng.randint(1, 3))) + "</div>"

    frame = [part(1) for _ in range(3)]
    pages = ["<body>" + "".join(f if rng.random() < 0.8 else part(1) for f in frame) + "</body>" for _ in range(8)]
    tokens = tokens_of_pages(pages)
    got = html_extract.valid_classes(8, tokens, 0.5, 3, 2)
    assert [{t[:2] for t in c} for c, _ in got] == plain_classes(8, tokens, 0.5, 3, 2)


def lonely(k):
    """A host whose pages end in one of two lone lines, and a box of links and a fixed line on all of them."""
    line = "Only in spring and summer" if k < 3 else "Only in autumn and winter"
    return f'<body><div class="post"><h1>Page {k}</h1><p>{"word " * (k + 5)}{k}</p></div><div class="box"><p>One fixed line for all</p></div>{line}</body>'


def test_vectors_decide():
    pages = [lonely(k) for k in range(6)]
    tokens = tokens_of_pages(pages)
    found = html_extract.deduce("h", 6, tokens, 0.5, 3)
    # Each line is alone in its class, so it is no template text and the slot must hold it.
    assert found["slot"] == "/body" and "Only in spring and summer" in extracted(pages, found)[0]
    # Vectors that are all equal put both lines into one class of two, whose texts then are template.
    equal = html_extract.deduce("h", 6, [(*t[:4], 0, *t[5:]) for t in tokens], 0.5, 3)
    assert equal["slot"] == "/body/div.post" and extracted(pages, equal)[0] == "Page 0\nword word word word word 0"
    # Vectors that are all different leave no class of two, so there is no template.
    differ = html_extract.deduce("h", 6, [(*t[:4], n, *t[5:]) for n, t in enumerate(tokens)], 0.5, 3)
    assert differ["slot"] is None and len(differ["tokens"]) == 1
    # The fixed line's class tells the post from the box, which a page alone can't.
    without = [p.split("Only in")[0] + "</body>" for p in pages]
    found = host_of_pages(without)
    assert found["slot"] == "/body/div.post" and extracted(without, found)[1] == "Page 1\nword word word word word word 1"
    assert html_extract.main_text(without[1]).endswith("One fixed line for all")


@pytest.mark.parametrize(
    "page,want",
    {
        "<p title='5\" > 4'>one": "one", '<p title=5">two': "two", "<p title='a>b'>three": "three", "<p a = \"x>\" b='y' c=z d>four": "four", '<p "odd>five': "five", "<p =x>six": "six", "<br/>x<br />y": "x\ny", "<p x=>seven": "seven",
        '<p x="never closed>eight': "eight", "<form><div><p>wrapped</p></div></form>": "wrapped", "<article><p>much longer text</p><form>a form</form><aside>an aside</aside></article>": "much longer text",
        '<article><p class="share price">Shares rose</p><div class="comment-on-law">The law</div><p>More</p></article>': "Shares rose\nThe law\nMore",
        '<div><p>the text of the page</p><div class="comments">so true</div><div id="ad-12">buy</div><ul class="related-posts"><li>x</li></ul></div>': "the text of the page",
    }.items(),
)
def test_attributes_forms_and_words(page, want):
    assert html_extract.main_text(page) == want


def test_headings_that_half_of_the_pages_share_stay():
    pages = [f"<body><nav><a href=x>Home</a></nav><article><h1>Dish {k}</h1><h2>Ingredients</h2><p>{k} eggs and {'more ' * k}</p></article><footer>Foot</footer></body>" for k in range(5)]
    assert [t.split("\n")[1] for t in extracted(pages, host_of_pages(pages))] == ["Ingredients"] * 5


def test_copies_on_one_host_keep_their_article():
    pages = [shop(1, line="x" * 50)] * 9 + [shop(k) for k in range(2, 6)]
    assert "Number 1 is" in extracted(pages, host_of_pages(pages))[0]
    assert "Number 1 is" in extracted(pages, host_of_pages(pages[:9]))[0]


def test_articles_named_by_number_are_one_token():
    pages = [f'<body><article id="post-{k}" class="post-{k} hentry"><p>words of page {k} here</p></article><div>Foot {k}</div></body>' for k in range(4)]
    found = host_of_pages(pages)
    assert found["slot"] == "/body/article.post-#.hentry"
    assert extracted(pages, found)[2] == "words of page 2 here"


def test_classes_nest_by_vectors():
    pages = [f"<body><ul>{'<li>x' * k}</ul><p>text {k} <b>one</b></p></body>" for k in range(1, 6)]
    tokens = {(t["path"], t["text"]): t for t in host_of_pages(pages)["tokens"]}
    item, root = tokens["/body/ul/li", 0], tokens["/body", 0]
    assert root["class"] == tokens["/body/p/b", 0]["class"] != item["class"] and item["inside"] == root["class"] and root["inside"] is None
    told = [t for t in tokens.values() if t["text"]]
    assert [t["path"] for t in told] == ["/body/ul/li"] and told[0]["class"] == item["class"]


def test_similar_classes_reach_every_link():
    rng = np.random.default_rng(5)
    sets, fps = [], []
    for k in range(60):
        own = rng.choice(1 << 40, 50, replace=False) if k % 4 == 0 else np.concatenate([sets[-1][3:], rng.choice(1 << 40, 3)])
        sets.append(np.unique(own).astype(np.uint64))
        fps.append(simhash.fold(sets[-1]))
    sets.append(np.empty(0, dtype=np.uint64))
    fps = np.array([*fps, 0], dtype=np.uint64)
    links = [(a, b) for a in range(61) for b in range(a) if len(sets[a]) and len(sets[b]) and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    for start in (0, 7, 60):
        got = simhash.similar_classes(sets, fps, start, 0.8, 64)
        want = components(61, links)
        assert len(set(got)) == len(set(want)) == len({(int(g), w) for g, w in zip(got, want, strict=True)}) and got[start] == start


def test_block_keys_catch_every_pair():
    keys = simhash.block_keys(2)
    assert len(keys) == 15 and min(sum(hi - lo for lo, hi in k) for k in keys) >= 42
    for a in range(64):
        for b in range(a):
            assert any(not any(lo <= x < hi for lo, hi in k for x in (a, b)) for k in keys)


def lattice_paths(token, model):
    """Every reading of a token with its log-probability, path by path."""
    paths = {((), 0): 0.0}
    runs = [(m[0][0], len(m[0])) for m in toxicity._RUN.finditer(token)]
    out = [((), 0, 0.0)]
    for ch, nth, run in ((c, k, n) for c, n in runs for k in range(n)):
        out = [(w if x < 0 else (*w, x), s if x < 0 else (s % 27) * 27 + x, p + c + (0 if x < 0 else model.log[s * 27 + x])) for w, s, p in out for x, c in toxicity._options(ch, nth, run)]
    del paths
    return [("".join(chr(96 + x) if x else " " for x in w).strip(), p + model.log[s * 27]) for w, s, p in out]


@given(st.text(alphabet="ab1o0!.s$ \n", max_size=9))
@settings(max_examples=150, deadline=None)
def test_viterbi_against_all_paths(token):
    text = " ".join(["so solo bass a sob also boss as"] * 20)
    c = np.concatenate([np.zeros(2, np.uint8), toxicity.letters(text), np.zeros(1, np.uint8)]).astype(int)
    model = toxicity.CharModel(np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3))
    paths = lattice_paths(token, model)
    best = max(p for _, p in paths)
    assert any(w == model.restore(token) and p > best - 1e-9 for w, p in paths)


def test_disguises_at_ends_and_over_gaps():
    text = " ".join(["the idiot and a clown or loser, you are trash with stupid scum the of and that moron asshole all good"] * 50)
    c = np.concatenate([np.zeros(2, np.uint8), toxicity.letters(text), np.zeros(1, np.uint8)]).astype(int)
    model = toxicity.CharModel(np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3))
    chosen = {"=idiot": 0, "^stup": 1, "=asshole": 2, "=moron": 3}
    for shown, feature in {"asshol3": 2, "stuupid": 1, "idiiot": 0, "you i d i o t": 0, "i  d  i  o  t": 0, "m\no\nr\no\nn": 3, "y o u  i d i o t": 0, "y o u i d i o t": 0, "!diot": 0, "(1d10t!!)": 0}.items():
        assert feature in toxicity.Reader(model, chosen).features(shown), shown
        # The shortcut by shapes loses nothing.
        plain = toxicity.Reader(model, chosen)
        plain.shapes = type("All", (), {"fit": lambda *a: True})()
        assert plain.features(shown) == toxicity.Reader(model, chosen).features(shown)
    assert not toxicity.Reader(model, chosen).features("good morning to all of you 2024")


def test_short_parted_and_foreign_disguises(monkeypatch):
    text = " ".join(["the idiot and a clown or loser, you are an ass with stupid poop the of and st. up id scum good cool"] * 50)
    c = np.concatenate([np.zeros(2, np.uint8), toxicity.letters(text), np.zeros(1, np.uint8)]).astype(int)
    model = toxicity.CharModel(np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3))
    chosen = {"=idiot": 0, "=stupid": 1, "=ass": 2, "=poop": 3, "=cool": 4}
    shown = {"you a s s": 2, "p o o p": 3, "p 0 0 p": 3, "st upid": 1, "so stu\n pid!": 1, "іdiot": 0, "ｉｄｉｏｔ": 0, "ＩＤ1ＯＴ": 0, "i\u200bdi\xadot": 0, "ѕtupіd": 1, "𝓼𝓽𝓾𝓹𝓲𝓭": 1, "īdïōt": 0, "i\u0335diot": 0}
    for said, feature in shown.items():
        assert feature in toxicity.Reader(model, chosen).features(said), said
    for said in ("- - - -", "a a a", "the as of", "привет мир", "good or bad", "id iot's own"):
        assert not toxicity.Reader(model, chosen).features(said), said
    # Any letter that a look-alike may stand for keeps its way to the lattice.
    monkeypatch.setitem(toxicity.LOOKALIKES, "(", "ck")
    monkeypatch.setattr(toxicity, "_GROUP", toxicity._alike())
    monkeypatch.setattr(toxicity, "_SHAPES", (toxicity._Shapes(True), toxicity._Shapes(False)))
    ducks = char_model("duck ducks ducky " * 60)
    assert 0 in toxicity.Reader(ducks, {"=duck": 0}).features("duc("), "second reading"


def char_model(text):
    c = np.concatenate([np.zeros(2, np.uint8), toxicity.letters(text), np.zeros(1, np.uint8)]).astype(int)
    return toxicity.CharModel(np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3))


@pytest.mark.parametrize("most", [1 << 22, 40])
def test_qgram_filter_against_every_stretch(most, monkeypatch):
    monkeypatch.setattr(decontam, "_MOST_HITS", most)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 30)))) for k in range(12)]
    texts = []
    for _ in range(60):
        chars = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
        texts.append(" ".join([*(word() for _ in range(rng.randint(0, 9))), "".join(chars), *(word() for _ in range(rng.randint(0, 9)))]))
    index = decontam.Index.build(items, 12, 0.05)
    got = {(k, i): e for k, i, _, e in index.search(texts)}
    want = {}
    for k, t in enumerate(texts):
        for n, i in enumerate(index.ids):
            edits = edit_distance_inside(bytes(index.items[n]), decontam.normalize(t))
            if edits <= index.budget[n]:
                want[k, i] = edits
    assert set(got) == set(want) and all(got[x] >= want[x] for x in got) and len(want) > 20
