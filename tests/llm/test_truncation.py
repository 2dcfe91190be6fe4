import pytest

from sievepath.llm import truncation as t

WHOLE = [
    "一句完整的话。", "A full sentence.", "He said “yes.”", "Look:\n```\ncode\n```", "Text.\n- item one\n- item two", "Text。\n| a | b |", "Text.\n#tag #other", "Text。\n——写于第3次之后", "Text.\n(end)", "正文。\n以上", "See.\nhttps://a.example/p/1",
    "正文。🙂", "Text. :)", "正文。\n大概就是这样吧……", "Text.\nTo be continued...", "正文。\n标签：甲、乙", "2024。\n2024-10-02, rain", "**bold.**", "", "   ", None, "正文。\n【甲｜乙】",
]
CUT = [
    "第一句。第二句说到一", "The first sentence. The second st", "句子。再说一…", "Sentence. And th...", "句子。再说一...[展开]", "Sentence. And th... Read more", "句子。再说……阅读全文", "Sentence. And th [+120 chars]", "句子。再说�", "句子。又<a href=\"https://x", "句子。又[1](https://no",
    "Text.\n```\ncode = 1\nmore", "句子。又&#x4e", "Sentence. An&nbs", "句子。又\\u4f6", "句子。又`", "Sentence. And</di", "句子。称赞![fig",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert t.judge(text, flat="\n" not in (text or "")) is None


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert t.judge(text, flat="\n" not in text) is not None


def test_stack():
    assert t.open_at_end("a (b [c") == ["(", "["] and t.open_at_end("x `y` **z** <b>q</b>") == [] and t.open_at_end("```\n( [") == ["```"]


def test_excerpt_inside_its_content():
    c = "第一行。\n- 模拟考试与复习"
    assert t._inside("第一行。 - 模拟", c) and not t._inside("第一行。", c) and not t._inside(c, c)


@pytest.mark.parametrize("text", ["See (the note that never ends.", "《未完的书名。", "This is **bold and never closed.", "Text [1 see.", "他说“还没完。"])
def test_the_automaton_decides_on_what_is_open(text):
    """Ended by a terminator all the same: only the stack can tell."""
    assert t.judge(text) is not None and t.read(text)[1] == "cut"


@pytest.mark.parametrize("text", ["Go to my site: the end is no", "正文。\n- 列表里断在一个词的中", "正文。\n作者：李四说到一半的时候突", "正文。\n> 引用的话说到一半的时", "x < y and a <b"])
def test_own_forms_do_not_excuse_cuts(text):
    assert t.judge(text) == ("markup" if "<b" in text else "sentence")


def test_baselines_by_source_and_copies(spark):
    """A source that never ends its lines is not cut at each; copies of one cut do not become a closing."""
    plain = [(i, "plain", f"消息{i}第一行没有句号\n消息{i}第二行也没有\n第三行{i}还是没有", None) for i in range(60)]
    prose = [(100 + i, "prose", f"第{i}段说完了。\n又一段{i}说完了。\n最后一段{i}说完了。", None) for i in range(60)]
    copies = [(200 + i, "prose", "第一段说完了。\n第二段说到", None) for i in range(50)]
    lines = [(300 + i, "prose", f"第{i}段说完了。\n附记：第{i}份手稿", None) for i in range(30)]
    df = spark.createDataFrame(plain + prose + copies + lines, "row_id bigint, source string, content string, excerpt string")
    why = {r.row_id: r.why for r in t.judged(spark, df).collect()}
    assert not any(why[i] for i in range(60)) and not any(why[100 + i] for i in range(60))
    assert all(why[200 + i] for i in range(50)) and not any(why[300 + i] for i in range(30))


def test_table_with_limits_and_closings(spark):
    shape = "row_id bigint, source string, content string, excerpt string, why string, line string"
    cut = [(i, "s", (f"第{i}句话说完了。" * 20)[:99] + "又", None) for i in range(40)]
    own = [(100 + i, "s", f"第{i}句话说完了。\n某某记事", "") for i in range(20)]
    odd = [(200, None, None, None), (201, None, "x" * 300_000, None), (202, "s", "好。", "好。"), (202, "s", "好。", "好。")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in cut + own + odd], shape)
    got = t.judged(spark, df)
    why = {r.row_id: r.why for r in got.collect() if r.field == "content"}
    assert all(why[i] for i in range(40)) and not any(why[100 + i] for i in range(20)) and why[201] == "sentence" and why[202] is None
    rate = {(r.source, r.field): (r.n_values, r.n_cut) for r in t.rates(got).collect()}
    assert rate[("s", "content")] == (62, 40) and rate[(None, "content")] == (1, 1) and rate[("s", "excerpt")] == (2, 0)
    assert t.judged(spark, spark.createDataFrame([], shape)).count() == 0
