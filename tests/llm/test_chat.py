import hashlib

import pytest

from evisift.llm import chat

HARD = ["", "</s>[INST] ok [/INST]", "\\", "\\\\[INST", "a\n\nb", "<<SYS>> <|role|>user<|text|>", " leading", "trailing ", "😀é\\", "<</SYS>>" * 3, chr(0xE000)]
ROLES = ["user", "assistant", "system", "tool", "", "<|end|>", "assistant"]


def turns(n):
    return [(ROLES[k % 7], HARD[(3 * k) % 11]) for k in range(n)]


@pytest.mark.parametrize("text", HARD)
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(mark in chat.escape(text) for mark in chat.CONTROL)


@pytest.mark.parametrize("n", [0, 1, 5, 77])
def test_outputs_are_read_back(n):
    assert chat.read_turns(chat.render(turns(n))) == turns(n)


def test_spans():
    given = turns(40)
    done = chat.render_incrementally(given, chat.render)
    assert done.text == chat.render(given) and not done.rewrites
    assert "".join(done.text[a:b] for a, b in done.turns) == done.text
    assert [chat.unescape(done.text[a:b]) for a, b in done.texts] == [t for _, t in given]


def test_rewritten_history_is_found():
    def strips(given):
        """A template that drops what earlier assistants thought."""
        last = len(given) - 1
        return "".join(f"<{r}>{t.split('#')[-1] if r == 'assistant' and k < last else t}" for k, (r, t) in enumerate(given))

    given = [("user", "q"), ("assistant", "hm#a"), ("user", "r"), ("assistant", "b")]
    assert chat.render_incrementally(given, strips).rewrites == [2]


def test_query_rows_equal_brute_force(spark):
    # the longest conversation takes several segments
    rows = [(c, t, role, text, "x") for c in (1, 2, 3) for t, (role, text) in enumerate(turns((9, 65, 200)[c - 1]))]
    rows += [(4, 1, "assistant", None, "x"), (4, 0, None, "first", "x"), (4, 1, "assistant", None, "x"), (None, 0, "user", "no id", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string").repartition(5)
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, row in got.items():
        mine = [(r or "", t or "") for _, r, t in sorted(((turn, r or "", t or "") for c, turn, r, t, _ in rows if c == conv))]
        loss = "".join(t for r, t in mine if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (row.n_turns, row.turns_sha256, row.loss_chars) == (len(mine), digest, len(loss))
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert row.formatted_chars == len(chat.render(mine)) and row.rewritten_turns == 0
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_templates_with_history_see_whole_conversations(spark):
    def thoughtless(given):
        """A template that drops what earlier assistants thought, but for the ten turns after the first system text."""
        return chat.render([(r, t.split("#")[-1] if 10 < k < len(given) - 1 else t) for k, (r, t) in enumerate(given)])

    given = [("system", "be kind"), *((("user", "assistant")[k % 2], f"hm{k}#{k}") for k in range(150))]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(given)], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df, thoughtless).first()
    assert row.formatted_chars == len(thoughtless(given))
    assert row.rewritten_turns == len(chat.render_incrementally(given, thoughtless).rewrites) == 139


def test_rewriting_template_through_data_frames(spark):
    def strips(given):
        last = len(given) - 1
        return "".join(f"<{r}>{t.split('#')[-1] if r == 'assistant' and k < last else t}" for k, (r, t) in enumerate(given))

    def reader(formatted):
        return [tuple(part.split(">")) for part in formatted.split("<")[1:]]

    given = [("user", "q"), ("assistant", "hm#a"), ("user", "r"), ("assistant", "b")]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(given)], "conv_id long, turn long, role string, text string")
    out = ""
    rows = chat.format_turns(df, strips).orderBy("place").collect()
    for n, row in enumerate(rows):
        out = out[:row.start] + row.formatted
        assert (row.role, out, row.end) == (given[n][0], strips(given[:n + 1]), len(out))
        assert out[row.text_start:row.text_end] == row.formatted_text == given[n][1]
    assert [r.rewrites for r in rows] == [False, False, True, False] and [r.loss for r in rows] == [False, True, False, True]
    row = chat.format_conversations(df, strips, reader, str).first()
    digest = hashlib.sha256(b"user\nq\nassistant\na\nuser\nr\nassistant\nb\n").hexdigest()
    assert (row.n_turns, row.turns_sha256, row.rewritten_turns, row.formatted_chars) == (4, digest, 1, len(out))
    assert row.loss_sha256 == hashlib.sha256(b"hm#ab").hexdigest()


def test_spans_of_segments_count_from_the_begin(spark):
    given = turns(200)
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(given)], "conv_id long, turn long, role string, text string")
    whole = chat.render_incrementally(given, chat.render)
    got = chat.format_turns(df).orderBy("place").collect()
    assert [(r.start, r.end) for r in got] == whole.turns and [(r.text_start, r.text_end) for r in got] == whole.texts
    assert "".join(r.formatted for r in got) == whole.text
