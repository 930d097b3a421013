"""Pages that rules of one language, one marker or one end tag would lose."""

import time

import pytest

from tessera.llm.html import main_text

STORY = "The council said on Monday that it would open the new bridge to all of the traffic by the end of the year, and that it was ready. "
ONE, TWO = (STORY * 4).strip(), (STORY * 3).strip()
CHINESE = ["昨天，北京市政府宣布了一项新的交通计划，市民们对此表示欢迎。" * 4, "专家认为，这项计划将改善城市的空气质量，但也需要更多的资金。" * 3]
RUSSIAN = [("Вчера правительство города объявило о новом плане, который изменит движение транспорта. " * 3).strip(), ("Эксперты считают, что план улучшит воздух, но потребует больших денег. " * 3).strip()]


def page(*parts):
    return "<html><body>" + "".join(f"<p>{p}</p>" for p in parts) + "</body></html>"


@pytest.mark.parametrize("prose", [CHINESE, RUSSIAN], ids=["Chinese", "Russian"])
def test_prose_without_known_stop_words(prose):
    html = f'<body><ul class="menu"><li><a href="/">首页 Главная</a></li><li><a href="/a">新闻 Новости</a></li></ul><div>{page(*prose)}</div><footer>© 2024</footer></body>'
    assert main_text(html) == "\n".join(prose)


@pytest.mark.parametrize("tag", "canvas option svg object select noscript iframe video template datalist".split())
def test_an_element_without_an_end_does_not_swallow_the_story(tag):
    assert main_text(f"<body><{tag}><p>{ONE}</p><p>{TWO}</p></body>") == f"{ONE}\n{TWO}"


@pytest.mark.parametrize("tag", "script style textarea title".split())
def test_an_element_that_holds_no_markup_does(tag):
    assert main_text(f"<body><p>{ONE}</p><{tag}><p>{TWO}</p></body>") == ONE


@pytest.mark.parametrize("name", ["legal", "content-related", "main-footer", "sidebar", "promo", "share"])
def test_a_marked_frame_of_the_whole_story_is_kept(name):
    assert main_text(f'<body><div class="{name}"><p>{ONE}</p><p>{TWO}</p></div></body>') == f"{ONE}\n{TWO}"
    assert main_text(f'<body><p>{ONE}</p><p>{TWO}</p><div class="{name}"><p>{TWO}</p></div></body>') == f"{ONE}\n{TWO}"


@pytest.mark.parametrize("name", ["comments", "cookie-consent", "ad", "hidden", "nav"])
def test_some_marks_are_no_frames(name):
    assert main_text(f'<body><div class="{name}">' + f"<p>{TWO}</p>" * 9 + f"</div><p>{ONE}</p></body>") == ONE


def test_a_line_of_rights_is_not_a_mention_of_them():
    photo = "Photo © Reuters shows the bridge and the river on the day of the opening of it."
    assert main_text(page(ONE, photo, TWO, "© 2024 The Paper. All rights reserved.", "Copyright The Paper and all of its authors.")) == f"{ONE}\n{photo}\n{TWO}"


def test_spans_of_adverts_go_with_the_spans_in_them():
    assert main_text(page(f"{ONE} <span class=ad>buy <span>cheap</span> pills today</span> And so on.")) == f"{ONE} And so on."
    assert main_text(page(f"{ONE} <span class=ad>buy pills", TWO)) == f"{ONE}\n{TWO}"


@pytest.mark.parametrize("piece", ["<span class=ad>", "<span class=ad>x<option>", "<canvas>", "<div class=ad>", "<head>"])
def test_time_grows_with_the_page(piece):
    def seconds(n):
        began = time.process_time()
        main_text(piece * n + "x")
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.02)
