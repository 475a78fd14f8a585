import numpy as np

from loomspark.llm import mincut

STORY = "A long paragraph of text that tells a story about many things, and it ends with a full stop after more than twenty words."


def test_only_the_hidden_attribute_hides():
    for given in ('style="overflow:hidden"', 'aria-hidden="false"', 'title="the hidden city"', "data-hidden=1", "class='hidden city'"):
        assert [b.text for b in mincut.blocks(f"<div {given}><p>{STORY}</p></div>")] == [STORY], given
    for given in ("hidden", 'class="a" HIDDEN', 'hidden="hidden"', "hidden=''"):
        assert mincut.blocks(f"<div {given}><p>{STORY}</p></div>") == [], given


def test_head_ends_without_its_end_tag():
    for after in (f"<body><p>{STORY}</p>", f"<p>{STORY}</p>", f"<span>{STORY}</span>", STORY):
        assert [b.text for b in mincut.blocks(f"<html><head><title>T</title><meta charset=utf-8><script>x</script>\n{after}")] == [STORY], after
    assert mincut.blocks("<head><title>T</title><style>p{}</style></head>") == []


def test_layout_classes_are_no_marks():
    for before in ('<body class="single-post has-sidebar">', '<html class="no-search">', '<div class="layout sidebar-right"><article>', '<div class="layout sidebar-right"><div role="main">'):
        assert not any(b.other for b in mincut.blocks(f"{before}<p>{STORY}</p>")), before
    for before in ('<div class="sidebar"><article>', '<div class="comments-area"><article>', '<article><div class="sidebar-right">', '<div class="site-footer">'):
        assert all(b.other for b in mincut.blocks(f"{before}<p>{STORY}</p>")), before
    assert STORY in mincut.main_text(f'<body class="single-post has-sidebar"><article><p>{STORY}</p></article>', mincut.PLAIN)


def test_visible_text_is_kept_around_silent_and_foreign_elements():
    for given, text in (
        ('<p>Hello there <svg class="i"/></p><p>Next.</p>', ["Hello there", "Next."]),
        ("<p>Hello <video>no video</p><p>Next.</p>", ["Hello", "Next."]),
        ("<p>It is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then.</p>", ["It is x=2 then."]),
        ("<p>Press <button>Start</button> now.</p>", ["Press Start now."]),
        ("<p>See <svg><text>label</text></svg> and <object>text</object>.</p>", ["See label and text ."]),
    ):
        found = [b.text.replace(" .", ".") for b in mincut.blocks(f"<article>{given}</article>")]
        assert found == [t.replace(" .", ".") for t in text], given
    assert all(b.other for b in mincut.blocks("<article><form><label>Mail</label><button>Send</button></form></article>"))


def test_training_weighs_rows():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones((40, 1)), rng.random((40, mincut.FEATURES - 1))], axis=1)
    y, times = rng.integers(0, 2, 40).astype(float), rng.integers(1, 200, 40)
    assert np.allclose(mincut.fit(x, y, times.astype(float)), mincut.fit(np.repeat(x, times, axis=0), np.repeat(y, times), np.ones(int(times.sum()))), atol=1e-6)
