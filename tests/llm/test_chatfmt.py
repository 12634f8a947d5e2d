"""Round trips of formatted conversations, the template language, and digests against plain Python."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from grainloom.llm import chatfmt

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|says|>"]
nasty = st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "\\\\", "a", "\n", "", "é\U0001f600"]), max_size=8).map("".join)


@given(nasty)
def test_escape_is_reversible_and_hides_control_strings(text):
    out = chatfmt.escape(text)
    assert chatfmt.unescape(out) == text
    assert not any(c in out for c in CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>"]), nasty), min_size=1, max_size=6))
def test_rendering_reads_back(turns):
    text, spans = chatfmt.compiled(chatfmt.TEMPLATE)([{"role": r, "text": t, "first": i == 0} for i, (r, t) in enumerate(turns)])
    assert [(chatfmt.unescape(a), chatfmt.unescape(b)) for a, b in chatfmt._TURN.findall(text)] == turns
    assert "".join(chatfmt.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_language():
    say = lambda s: chatfmt.compiled(s)([{"role": "user", "text": " Hi ", "first": True}])[0]
    assert say("{% for m in messages %}{{ m.text | trim | upper }}{% if not m.role == 'x' and m.first %}!{% else %}?{% endif %}{% endfor %}") == "HI!"
    assert say("{{ 'a' + 'b' }}{% if 'a' == 'b' %}no{% elif 'a' != 'b' %}yes{% endif %}") == "abyes"
    folded = chatfmt.fold(chatfmt.Parser("x{{ 'a' + 'b' | upper }}{% if 'a' == 'a' %}y{% endif %}").parse())
    assert [(p.kind, p.value) for p in folded.parts] == [("const", "xaBy")]
    for bad in ("{{ m.__class__ }}", "{{ open }}", "{% for x in y %}{% endfor %}", "{% if 'a' %}", "{{ 'a' | eval }}", "{% import os %}", "{{ 'a' 'b' }}"):
        with pytest.raises(chatfmt.TemplateError):
            chatfmt.compiled(bad)


def test_frames(spark, monkeypatch):
    rows = [(1, 1, "assistant", "a</s>"), (1, 0, "user", None), (1, 1, "assistant", "a</s>"), (2, None, None, "x"), (2, 0, "assistant", ""), (None, 0, "assistant", "[INST]")]
    rows += [(7, i, ("user", "assistant")[i % 2], f"t<{i}\n") for i in range(700)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    formatted = chatfmt.format_conversations(df)
    assert formatted.where("conv_id = 7").count() == 3
    got = {r.conv_id: r for r in chatfmt.read_back(formatted).collect()}
    want: dict = {}
    for c, t, r, x in sorted(rows, key=lambda r: tuple((v is not None, v) for v in r)):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(said))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chatfmt.read_back(chatfmt.format_conversations(df.limit(0))).count() == 0


def test_shown_comparisons():
    messages = [{"role": "user", "text": "x"}]
    for source, out in (("x{{ 'a' == 'a' }}", "xtrue"), ("{{ 'a' != 'a' }}y", "falsey"), ("{% for m in messages %}{{ m.role == 'user' }}!{% endfor %}", "true!"), ("{{ not 'a' }}", "false")):
        assert chatfmt.compiled(source)(messages)[0] == out
