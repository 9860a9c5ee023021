"""What readers, advertisers and notices add stays out at every share; nothing is lost behind odd tags; linear time."""

import time

import pytest

from matstream.llm import htmlcut
from tests.llm.test_page_vector_lm import BODY, TEXT

SAY = "I have read this twice now and cannot agree with a single word of what it says here."


def page_of(share, name, where):
    body = "\n".join(TEXT)
    n = max(1, round(share / (1 - share) * len(body) / len(SAY)))
    added = f'<section {name}>' + "".join(f"<p>{SAY}</p>" for _ in range(n)) + "</section>"
    inside, behind = (added, "") if where == "inside" else ("", added)
    return f"<html><body><article><h1>Flood</h1>{BODY}{inside}</article>{behind}</body></html>"


@pytest.mark.parametrize("where", ["inside", "behind"])
@pytest.mark.parametrize("name", ['id="comments"', 'class="cookie-notice"', 'class="ad"', 'class="newsletter signup"', 'id="respond"'])
@pytest.mark.parametrize("share", [0.1, 0.3, 0.44, 0.5, 0.7, 0.9])
def test_added_text_stays_out_at_every_share(share, name, where):
    assert htmlcut.main_text(page_of(share, name, where)) == "\n".join(["Flood", *TEXT])


def test_comments_in_articles_of_their_own_stay_out():
    many = "".join(f"<article><p>{SAY}</p></article>" for _ in range(20))
    page = f'<main>{BODY}</main><section id="comments">{many}</section>'
    assert htmlcut.main_text(page) == "\n".join(TEXT)


@pytest.mark.parametrize("page", [
    f'<div class="popup"><h1>Flood</h1>{BODY}</div>',
    f'<div class="comments-open"><article><h1>Flood</h1>{BODY}</article><div id="comments"><p>{SAY}</p></div></div>',
])
def test_the_only_article_or_heading_is_kept_in_such_a_wrapper(page):
    assert htmlcut.main_text(page) == "\n".join(["Flood", *TEXT])


def test_a_notice_alone_is_no_text():
    assert htmlcut.main_text(f'<body><div class="cookie-consent">{BODY}</div></body>') == ""


@pytest.mark.parametrize("odd", ["<svg/>", '<svg width="1" />', '<object data="x" />', "<object data=x>", "<math/>",
                                 "<canvas>", "<select>", "<button-group>", "<select-box>", "<head-line>"])
def test_nothing_is_lost_behind_odd_tags(odd):
    assert htmlcut.main_text(f"<body><article>{odd}{BODY}</article></body>") == "\n".join(TEXT)


def test_an_unclosed_button_ends_before_the_next():
    got = htmlcut.main_text(f"<article><p>Go <button>on</p>{BODY}<p>x <button>OK</button></p></article>")
    assert all(t in got for t in TEXT) and "OK" not in got


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</b></section>" * 50_000, "</p>" * 100_000, "<head>" * 100_000,
                                  "<button>x" * 50_000, "<svg>" * 100_000, "<script" * 50_000 + ">"])
def test_stray_tags_take_linear_time(page):
    t = time.perf_counter()
    htmlcut.main_text(page + BODY)
    assert time.perf_counter() - t < 4
