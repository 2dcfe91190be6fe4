import copy
import itertools
import re

import numpy as np
import pytest

from sievepath.llm import pii

MODEL = pii.Model("怀溪景望", ("maren", "lindqvarn", "orla", "o'farrowen"))


def found(text, model=MODEL):
    return [(k, text[a:b]) for a, b, k in pii.spans([text], model)[0]]


@pytest.mark.parametrize(
    "text, want",
    [
        ("写信到a.b+c@mail.x.example，谢谢", [("email", "a.b+c@mail.x.example")]),
        ("Write to ab (at) x (dot) y (dot) test if", [("email", "ab (at) x (dot) y (dot) test")]),
        ("发到ab.12#x-mail.example。", [("email", "ab.12#x-mail.example")]),
        ("ab＠x.example", [("email", "ab＠x.example")]),
        ("格式写成 user@ 就会报错，见@夜读 的评论", []),
        ("电话 154.9397.2109，晚上打", [("phone", "154.9397.2109")]),
        ("电话１５４０８９６５９４８。", [("phone", "１５４０８９６５９４８")]),
        ("房东（一五四七五一〇〇八四五）说", [("phone", "一五四七五一〇〇八四五")]),
        ("联系(+86)15439216337。", [("phone", "(+86)15439216337")]),
        ("Call +44 7700 900441. After 36 days", [("phone", "+44 7700 900441")]),
        ("版本 10.0.50.11 修好了", []),
        ("内容编号4031722172已经下架", []),
        ("时间是2025-02-16 12:33", []),
        ("身份证号917612 19741007 1057，别填错", [("id_number", "917612 19741007 1057")] if pii.resident_ok("917612197410071057") else []),
        ("my social security number, 666-01-7106, for", [("id_number", "666-01-7106")]),
        ("护照号XQ4042804，已经", [("id_number", "XQ4042804")]),
        ("收货地址：霜岭市南汀区桂影街145弄8号3栋1084室，收件人程景怀。", [("street_address", "霜岭市南汀区桂影街145弄8号3栋1084室"), ("name", "程景怀")]),
        ("收货地址：栖云区白鹭大道甲9号。松风路的桂花开了", [("street_address", "栖云区白鹭大道甲9号")]),
        ("a room at Flat 12, 357 Saltmarket Road, Corvendale. The", [("street_address", "Flat 12, 357 Saltmarket Road, Corvendale")]),
        ("We trained 14 Alder Road Runner toys", []),
        ("My neighbour Maren Lindqvarn moved to town", [("name", "Maren Lindqvarn")]),
        ("Thanks to O'Farrowen, Orla for reading", [("name", "O'Farrowen, Orla")]),
        ("林老师说不用急。The Harbor Method and the Quiet Engine", []),
        ("感谢同事温溪帮我校对", [("name", "温溪")]),
        ("Yesterday I met Sarah Johnson in Paris.", [("name", "Sarah Johnson")]),
        ("Our CEO, Robert Brown, resigned.", [("name", "Robert Brown")]),
        ("王小明昨天去了北京。", [("name", "王小明")]),
        ("张伟说他不来了。", [("name", "张伟")]),
    ],
)
def test_kinds(text, want):
    assert found(text) == want


def test_check_character():
    base = "91010119900101123"
    total = sum(int(c) * (2 ** (17 - i) % 11) for i, c in enumerate(base))
    assert pii.resident_ok(base + "10X98765432"[total % 11])
    assert sum(pii.resident_ok(base + c) for c in "0123456789X") == 1


def test_skip_edges_lift_unclear_mentions():
    clear, unclear = "感谢同事温怀溪帮我校对。", "今天温怀溪也在"
    assert ("name", "温怀溪") not in found(unclear)
    assert found(clear + "别的。" + unclear).count(("name", "温怀溪")) == 2


def test_without_skip_edges_the_unclear_mention_is_lost():
    model = pii.Model(MODEL.given, MODEL.words)
    model.skip = {k: (0.0, 0.0) for k in model.skip}
    text = "感谢同事温怀溪帮我校对。别的。今天温怀溪也在"
    assert found(text).count(("name", "温怀溪")) == 2 and found(text, model).count(("name", "温怀溪")) == 1


def test_similar_words_share_a_skip_edge():
    seen = {}
    assert pii._alike(seen, "lindqvarn") == pii._alike(seen, "lindqvarm") == pii._alike(seen, "lindqvar") != pii._alike(seen, "penhallick")


def test_chain_against_enumeration():
    """Marginals of random segments agree with going through all labellings."""
    rng = np.random.default_rng(3)
    start, size = np.array([0, 3, 4]), np.array([3, 1, 4])
    node, chain = rng.normal(size=(8, 4)), rng.normal(size=(4, 4))
    alpha, beta, *_ = pii._chain(node, start, size, chain)
    got = pii._marginals(alpha, beta)
    for s, n in zip(start, size):
        total, mass = 0.0, np.zeros((n, 4))
        for y in itertools.product(range(4), repeat=int(n)):
            w = np.exp(sum(node[s + t, y[t]] for t in range(n)) + sum(chain[y[t], y[t + 1]] for t in range(n - 1))) * pii._START[y[0]] * pii._LAST[y[-1]]
            total += w
            for t in range(n):
                mass[t, y[t]] += w
        assert np.allclose(mass / total, got[s : s + n])


def test_long_segments_go_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    node, chain = rng.normal(size=(700, 4)), rng.normal(size=(4, 4))
    start, size = np.array([0, 500, 510]), np.array([500, 10, 190])
    got = pii._marginals(*pii._chain(node, start, size, chain)[:2])
    monkeypatch.setattr(pii, "_BLOCK", 1000)
    assert np.allclose(got, pii._marginals(*pii._chain(node, start, size, chain)[:2]))


def test_fit_learns_contexts_and_parts():
    """Names of invented parts in a context without any cue are learned from labelled fields; held out rows tell."""
    rng = np.random.default_rng(1)
    family, given = "陆沈顾谢傅", "衿桐岫珩栩砚翎霁"
    name = lambda: family[rng.integers(5)] + "".join(given[i] for i in rng.integers(0, 8, rng.integers(1, 3)))
    plain = ["大家都觉得金石小店很安静。", "今天的江边风很大，石头路很滑。", "高楼旁边的方桌上有白花。"]
    texts = []
    for i in range(600):
        a, b = name(), name()
        texts.append(f"作者：{a}\n{plain[i % 3] * 2}窗外走过的{b}{("接手了这件事", "写下了这句话", "认为没有问题", "负责后面的部分")[rng.integers(4)]}。{plain[(i + 1) % 3]}")
    model = pii.fit(texts[:400])
    truth = hits = found_ = 0
    for t in texts[400:]:
        want = {m.start(1) for m in re.finditer(r"作者：(.*)\n", t)} | {m.start(1) for m in re.finditer(r"走过的(.*?)(?:接手|写下|认为|负责)", t)}
        got = {a for a, _, k in pii.spans([t], model)[0] if k == "name"}
        truth, hits, found_ = truth + len(want), hits + len(want & got), found_ + len(got)
    assert hits >= 0.7 * truth and hits >= 0.95 * found_


def test_every_row_is_counted_and_fitted(spark):
    """The model of a table is that of all its texts, however many and however they are spread."""
    rng = np.random.default_rng(2)
    family, given = "陆沈顾谢傅", "衿桐岫珩栩砚翎霁"
    name = lambda: family[rng.integers(5)] + "".join(given[i] for i in rng.integers(0, 8, 2))
    texts = [f"作者：{name()}\n今天{name()}写下了{("高楼", "江风", "林间")[i % 3]}的事。" + ("电话 15408965948。" if i % 50 == 0 else "") for i in range(2600)]
    got = pii.Finder(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).model
    want = pii.fit(texts)
    assert got.given == want.given and got.words == want.words and got.usual.tolist() == want.usual.tolist() and got.usual_pairs == want.usual_pairs
    assert np.allclose(got.table, want.table, atol=1e-4) and np.allclose(got.name, want.name, atol=1e-4) and got.skip == want.skip


def test_equal_segments_count_by_their_number():
    texts = ["作者：陆衿桐\n今天陆衿桐写下了这件事。", "作者：沈岫\n电话 15408965948。"]
    once, thrice = pii.Model(), pii.Model()
    one, three = (pii._Examples([pii.Kept(pii.Field(t, m, True), m, pii._codes({"陆衿桐", "沈岫"}), pii._firm(t)) for t in (texts,) * k], m, False) for m, k in ((once, 1), (thrice, 3)))
    a, b = (x.gradient(np.zeros((pii.BUCKETS, 3)), pii.Model()) for x in (one, three))
    assert len(one.y) == len(three.y) > 0 and (three.times == 3 * one.times).all() and np.allclose(3 * a[1], b[1]) and np.allclose(3 * a[2], b[2]) and np.allclose(3 * a[3], b[3])


def test_mask_and_edges(spark):
    rows = [(1, "电话 15408965948，好"), (1, "电话 15408965948，好"), (None, "邮箱a@b.example"), (2, None), (3, ""), (4, "长文" * 100_000 + "电话 15408965948")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, kind string, start_pos int")
    f = pii.Finder(spark, df)
    masked = {r.doc_id: r.masked_text for r in f.masked().collect()}
    assert masked[1] == "电话 [PHONE]，好" and masked[None] == "邮箱[EMAIL]" and masked[2] is None and masked[3] == "" and masked[4].endswith("电话 [PHONE]")
    spans = sorted((r.doc_id or 0, r.kind, r.start_pos) for r in f.spans().collect())
    assert spans == [(0, "email", 3), (1, "phone", 4), (1, "phone", 4), (4, "phone", 200_004)]
    assert pii.Finder(spark, df.limit(0)).spans().count() == 0


def test_segments_of_three_tokens_as_all_others():
    """The closed form for one beginning and two tokens gives the gradient that the chain gives."""
    texts = ["作者：陆衿桐\n今天陆衿桐写下了这件事。高楼的白花，江边的石头路。方便的时候再说", "大家都觉得金石小店很安静，安排在高中。"]
    model = pii.Model()
    one = pii._Examples([pii.Kept(pii.Field(texts, model, True), model, pii._codes({"陆衿桐"}), pii._firm(texts))], model, False)
    other, rng = copy.copy(one), np.random.default_rng(7)
    inner = np.ones(len(one.y), dtype=bool)
    inner[np.cumsum(one.size) - 1] = False
    i = np.flatnonzero(inner)
    other.three, other.inner = 0, i
    other.steps = np.bincount(one.y[i] * 4 + one.y[i + 1], np.repeat(one.times, one.size)[i], minlength=16).reshape(4, 4)
    w = rng.normal(size=(pii.BUCKETS, 3))
    assert 0 < one.three < len(one.size)
    assert all(np.allclose(a, b) for a, b in zip(one.gradient(w, model)[:4], other.gradient(w, model)[:4]))


def test_plain_segments_are_kept_once_over_all_tasks(spark, monkeypatch):
    """Beginnings that are words are kept once for the whole table, not once for each task or turn, and found rows are those of the texts."""
    kept = []
    fit = pii._fit
    monkeypatch.setattr(pii, "_fit", lambda over, *a: (kept.append([pii._unpacked(r[1]) for r in over.blocks.collect() if r[0]]), fit(over, *a, turns=1))[1])
    lines = [f"第{a}座{b}，方便的时候再说。" for a in "一二三四五六七" for b in ("高楼很高", "白花很白", "江边风大", "石头路滑")]
    texts = [f"{x}\n作者：陆衿桐\n电话 15408965948。" for x in lines]
    for times in (1, 6):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * times)], "doc_id bigint, text string").repartition(4)
        f = pii.Finder(spark, df)
        got = sorted((r.doc_id, r.kind, r.start_pos, r.end_pos) for r in f.spans().collect())
        assert got == sorted((i, k, s + 1, e) for i, t in enumerate(texts * times) for s, e, k in pii.spans([t], f.model)[0])
    a, b = (sum(len(p[0]) for p in x) for x in kept)
    assert a == b > 0 and 6 * sum(p[1].sum() for p in kept[0]) == pytest.approx(sum(p[1].sum() for p in kept[1]))


def test_quick_looks_miss_nothing():
    """Expressions that the block's characters rule out find nothing, and stated names are those of the whole expression."""
    texts = ["见 a @ b.example", "ab at x dot y dot test", "ab (at) x (dot) y (dot) test", "电话（０１０）６２３４５６７８", "电话 𝟏𝟓𝟒𝟎𝟖𝟗𝟔𝟓𝟗𝟒𝟖。", "SSN 666-01-7106", "护照号XQ4042804", "14 Alder Road", "艾特ab", "ab艾特x.example", "", "一五四七五一〇〇八四五", "1 2 3 4 5 6 7", "Dear Dr. Maren  Lindqvarn, Mrs. Orla K. Webb\nAuthor: A'b Cd. Name:  Ef Gh"]
    for t in texts:
        want = pii.forms(t)
        got = pii.Field([t, "无"], pii.Model()).forms
        assert [f[:3] for f in got] == [f[:3] for f in want]
        assert [m.span() for m in pii._stated_en(t)] == [m.span() for m in pii._SEED_EN.finditer(t)]
