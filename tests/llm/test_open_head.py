from listingloom.llm import html_extraction as h


def test_a_head_ends_where_something_else_begins():
    assert h.main_lines(h.lines_of("<html><head><title>t</title><meta charset=x><p>text"), []) == ["text"]
    assert h.main_lines(h.lines_of("<head><style>p{}</style><noscript><p>no</p></noscript></head><body>a"), []) == ["a"]
