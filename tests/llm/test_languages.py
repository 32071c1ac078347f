"""Pages in languages without known stop words, and links and comments around the article."""

import pytest

from sealbook.llm.html_text import main_text

MENU = "<nav><a href='/'>Home</a></nav><ul><li><a href='a'>aaa bbb</a></li><li><a href='b'>ccc ddd eee fff</a></li></ul>"
PROSE = {
    "ru": "Сегодня утром жители города вышли на улицы, чтобы увидеть праздник. Погода была ясной, и многие взяли с собой детей. "
          "На площади играла музыка, а вечером зажгли огни. Организаторы остались довольны: пришло больше людей, чем в прошлом году.",
    "zh": "今天早上，市民们走上街头观看节日庆典。天气晴朗，很多人带着孩子一起来。广场上演奏着音乐，晚上点亮了灯光。主办方表示满意，来的人比去年多。",
    "ar": "خرج سكان المدينة صباح اليوم إلى الشوارع لمشاهدة الاحتفال، وكان الطقس صافيا، وجاء كثيرون مع أطفالهم. "
          "عزفت الموسيقى في الساحة، وأضيئت الأنوار في المساء. أعرب المنظمون عن رضاهم، فقد حضر عدد أكبر من العام الماضي.",
}
FRAMES = {
    "article": "<html><body>{menu}<article><p>{a}</p><p>{b}</p></article><footer>© 2020</footer></body></html>",
    "div": "<html><body>{menu}<div><p>{a}</p><p>{b}</p></div><div class='footer'>© 2020</div></body></html>",
    "bare": "<html><body>{menu}<div>{a}</div><div>{b}</div></body></html>",
}


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("lang", PROSE)
def test_any_language(lang, frame):
    page = FRAMES[frame].format(menu=MENU, a=PROSE[lang], b=PROSE[lang][::-1].strip())
    assert main_text(page) == PROSE[lang] + "\n" + PROSE[lang][::-1].strip()


def test_short_page_in_another_language():
    assert main_text(f"{MENU}<div>{PROSE['zh'][:30]}</div>") == PROSE["zh"][:30]


def test_a_link_in_the_article_stays_and_a_list_of_links_goes():
    story = "This is the story of the day and it is told as it was. " * 5
    page = f"<article><p>{story}</p><p><a href='x'>See the full report</a></p><p>{story}</p><ul><li><a href='1'>One</a></li><li><a href='2'>Two</a></li></ul></article>"
    assert main_text(page) == f"{story.strip()}\nSee the full report\n{story.strip()}"


@pytest.mark.parametrize("name", ["user-reviews", "discussion", "thread", "reply", "reply-list", "comment-thread"])
def test_comments_by_other_names(name):
    story = "This is the story of the day and it is told as it was. " * 5
    assert main_text(f"<div><p>{story}</p></div><div class='{name}'><p>{story}</p></div>") == story.strip()


def test_a_discussion_inside_an_article_is_a_section_of_it():
    story = "This is the story of the day and it is told as it was. " * 5
    assert main_text(f"<article><section id='discussion'><p>{story}</p></section></article>") == story.strip()
