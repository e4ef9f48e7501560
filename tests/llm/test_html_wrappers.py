import pytest

from fieldloom.llm import htmltext

WORDS = "Some words, some more words, and a last clause of the sentence with enough text to count."
BODY = "".join(f"<p>{k} {WORDS}</p>" for k in range(6))
NAV = "<ul class=menu>" + "".join(f"<li><a href=/{k}>Section number {k}</a></li>" for k in range(9)) + "</ul>"
SIDE = "<div class=sidebar><p>Ads, ads, ads, ads and more ads</p></div>"


@pytest.mark.parametrize("head, tail", [("<form id=aspnetForm>", "</form>"), ("<div class='content no-sidebar'>", "</div>"), ("<div class='site-main has-nav'>", "</div>"), ("<div class='post widget'>", "</div>"), ("<aside>", "</aside>")])
def test_wrappers_that_hold_the_content_stay(head, tail):
    _, text, score = htmltext.extract(f"<body>{head}{NAV}<div>{BODY}</div>{SIDE}{tail}</body>")
    assert text.count(WORDS) == 6 and score > 0 and "Section number" not in text and "ads" not in text


def test_a_section_of_the_best_container_stays():
    _, text, _ = htmltext.extract(f"<body><article>{BODY}<section class='related-work'><p>Related, {WORDS}</p><p>{WORDS}</p><p>{WORDS}</p></section></article></body>")
    assert text.count(WORDS) == 9


def test_nearly_empty_results_are_extracted_again():
    linked = "".join(f"<p>{k} {WORDS} <a href=x>{WORDS}</a></p>" for k in range(6))
    _, text, _ = htmltext.extract(f"<body><form><div>{linked}</div></form><p>Copyright of nobody</p></body>")
    assert text.count(WORDS) == 12
    assert htmltext.extract("<body><form><p>Only a short text, in a form.</p></form></body>")[1] == "Only a short text, in a form."


def test_short_or_linked_parts_still_go():
    _, text, _ = htmltext.extract(f"<body><nav>{NAV}</nav><article>{BODY}{SIDE}</article><footer>Copyright of nobody</footer></body>")
    assert text.count(WORDS) == 6 and not any(x in text for x in ("Section", "ads", "Copyright"))
