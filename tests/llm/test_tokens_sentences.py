import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from srcquarry.llm import scan, sentences, tokens

PATH = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
with open(PATH, "rb") as f:
    LIBRARY = tiktoken.Encoding("check", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


def lists(counts, ids):
    ends = np.append(0, np.cumsum(counts))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="a's tdrevl \n\t1é字!", max_size=60)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library_and_decode(texts):
    counts, ids, offsets = tokens.encode_texts(texts, PATH, True)
    for t, got in zip(texts, lists(counts, ids)):
        assert got == LIBRARY.encode_ordinary(t or "")
        assert tokens.decode(got) == (t or "")
    assert len(offsets) == len(ids) and (not len(offsets) or offsets.min() >= 0)


def test_long_runs_and_control_strings():
    texts = ["x" * 20_000, " " * 5000, "<|endoftext|>", "ab" * 9000 + "\n" * 300, "'s've 'll"]
    counts, ids, _ = tokens.encode_texts(texts, PATH)
    assert lists(counts, ids) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_encode_column(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, None, 9), (3, "", 9), (1, "Hello world", 9)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_column(df, "doc_id", "text").collect())
    hello = LIBRARY.encode_ordinary("Hello world")
    assert got == [(1, hello), (1, hello), (2, []), (3, [])]
    off = {r.doc_id: r.offsets for r in tokens.encode_column(df, "doc_id", "text", "offsets").collect()}
    assert off[1] == [0, 5] and off[2] == []
    assert {r.doc_id: r.n_tokens for r in tokens.encode_column(df, "doc_id", "text", "count").collect()} == {1: 2, 2: 0, 3: 0}
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_scan_matches_a_loop():
    r = np.random.default_rng(3)
    for n in (0, 1, 17, 5000):
        table = r.integers(0, 6, (4, 6)).astype(np.uint8)
        cls = r.integers(0, 4, n)
        state, want = 2, []
        for c in cls:
            want.append(state)
            state = int(table[c, state])
        assert scan.states_before(cls, table, 2).tolist() == want


def split(text):
    _, a, b = sentences.sentence_spans([text])
    return [text[x:y] for x, y in zip(a, b)]


CASES = [
    ["Dr. Smith paid approx. 3.5 cents (see Fig. 2).", "It was late, etc.", "Then he left."],
    ["He said the U.S. mirror lags by 28.9 h.", "Never call it!", "Why not?!", "All 5 tests are green."],
    ["We saw it wait ... and then fail with code 914.", "One league per token.", "135 rows were lost..."],
    ['The reviewer asked "Is it shut? It must be." and left.', '"Who owns it?"', "(The table is rebuilt.)", "Fine."],
    ["The sheet said 'ok.' twice and won't stop.", "lowerCamel is null."],
    ["Die 45. Wiederholung lief durch.", "Am 3. Mai kam Version 1.2.3.", "Das gilt z. B. für Tests, d. h. für alle usw.", "Laut Nr. 4 ist er leer."],
    ["„Ist sie offen? Dann warte“, schrieb das Team.", "„Wer pflegt es?“", "Niemand."],
    ["« Qui s'occupe de ça ? »", "Cela touche p. ex. Foo, c.-à-d. tout.", "L'art. 9 dit non !", "Oui."],
    ["¿Quién lo mantiene?", "¡No llames!", "Véase la pág. 3 y la fig. 4.", "El núm. 7 ya está.", "—La caché está vieja —dijo el bot—, así que no sirve."],
    ["Команда спросила: «Замок закрыт? Должен быть», — и ушла.", "«Кто отвечает?»", "Это касается, напр., Foo, т. е. всех.", "Не хватает путей и т. д.", "Конец."],
    ["كتب الفريق: «هل القفل مغلق؟ يجب ذلك.» ثم ترك النقاش.", "لماذا؟", "انتظر الطابور ... ثم فشل."],
    ["डॉ. Foo ने टिकट बंद किया।", 'टीम ने पूछा, "क्या बंद है? होना चाहिए।" और चर्चा छोड़ दी।'],
]


@pytest.mark.parametrize("want", CASES)
def test_sentences_of_a_paragraph(want):
    assert split(" ".join(want)) == want
    wrapped = " ".join(want).replace(" ", "\n", 3)
    assert [s.replace("\n", " ") for s in split(wrapped)] == want


@pytest.mark.parametrize("want", [["担当者は「鍵は閉じているか？閉じるべきだ。」と書いた。", "「誰ですか。」", "待ち行列は……失敗した。", "なぜ？"], ["评审写道：“锁关了吗？必须关。”然后离开了讨论。", "“谁负责？”", "队列等了很久……然后失败。", "版本1.2.3来了！"]])
def test_sentences_without_spaces(want):
    assert split("".join(want)) == want


def test_layout():
    text = "# Title\n\nOverview\n\nOne two.\nThree four.\n1) First. Item\n2) second\n   goes on\n\n* a\n* b. c\n\n```java\nint x = 1. ;\n\n// y. Z\n```\nAfter it. End\r\n\r\nLast line"
    want = ["# Title", "Overview", "One two.", "Three four.", "1) First. Item", "2) second\n   goes on", "* a", "* b. c", "```java\nint x = 1. ;\n\n// y. Z\n```", "After it.", "End", "Last line"]
    assert split(text) == want
    assert split("คิวรอนาน ทีมงานปิด\nรุ่น1.2ใช้") == ["คิวรอนาน", "ทีมงานปิด", "รุ่น1.2ใช้"]
    assert split("fail with code\n914. One more\nline.") == ["fail with code\n914.", "One more\nline."]
    assert split("") == [] and split(" \n\t\n") == []
    assert split("```\nnever closed. Yes") == ["```\nnever closed. Yes"]


@given(st.lists(st.text(alphabet="aB.!?\"'()«»“”„ \n-1#`。？ก 」「", max_size=80), max_size=8))
@settings(max_examples=150, deadline=None)
def test_sentences_cover_everything_but_white_space(texts):
    doc, a, b = sentences.sentence_spans(texts)
    for k, t in enumerate(texts):
        spans = [(x, y) for d, x, y in zip(doc, a, b) if d == k]
        assert all(t[x:y] and t[x:y].strip() == t[x:y] for x, y in spans)
        assert "".join("".join(t[x:y].split()) for x, y in spans) == "".join(t.split())
        assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))


def test_one_batch_equals_single_texts():
    r = random.Random(8)
    texts = ["".join(r.choice(["A b. ", "C? ", "\n\n", "- x\n", "```\n", "“q.” ", "„z“ ", "e.g. y "]) for _ in range(r.randrange(30))) for _ in range(60)]
    doc, a, b = sentences.sentence_spans(texts)
    for k, t in enumerate(texts):
        _, x, y = sentences.sentence_spans([t])
        assert [(p, q) for d, p, q in zip(doc, a, b) if d == k] == list(zip(x, y))


def test_split_sentences(spark):
    df = spark.createDataFrame([(1, "Ab cd. Ef gh.", 0), (2, None, 0), (3, "", 0), (4, "  ", 0), (5, "x " * 30000, 0)], "doc_id long, text string, start_pos int")
    got = sorted((r.doc_id, r.start_pos, r.end_pos) for r in sentences.split_sentences(df).collect())
    assert got == [(1, 0, 6), (1, 7, 13), (5, 0, 59999)]
    assert sentences.split_sentences(df.limit(0)).count() == 0


def test_once_keeps_different_rows_of_a_key(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d"), (None, "e"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, tokens.once(df, "doc_id").collect())) == sorted(map(str, df.distinct().collect()))
    assert sorted(r.text for r in tokens.once(df.filter("text in ('b', 'c')"), "doc_id").collect()) == ["b", "c"]
    assert tokens.once(df.limit(0), "doc_id").count() == 0


def test_rules_look_as_far_as_they_have_to():
    far = "x" * 200
    for text, cut in ((f"It ends. {far}/path goes on.", 8), (f"It ends. {far} goes on.", None), (f"It ends.{' ' * 90}Then more.", 8), (f"It ends. {'(' * 30}Then more.", 8)):
        _, a, b = sentences.sentence_spans([text])
        assert (b[0] == cut) if cut else len(b) == 1, text


def test_word_automaton_equals_the_lists():
    words = sorted(sentences.GOES_ON | sentences.MAY_END | sentences.ORDINAL_BEFORE | {"zz", "e.gx", "", "etcetera", "d"})
    low = sentences.code_points("".join(words))
    ends = np.cumsum([len(w) for w in words])
    said = sentences.WORDS.says[sentences.WORDS.run(low, ends - [len(w) for w in words], ends)]
    for w, x in zip(words, said.tolist()):
        assert x == (w in sentences.GOES_ON) * 1 + (w in sentences.MAY_END) * 2 + (w in sentences.ORDINAL_BEFORE) * 4, w
