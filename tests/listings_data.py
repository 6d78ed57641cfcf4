"""Listings that the tests share; imported by name, as every folder of tests has a conftest of its own."""

# The five-record feed whose results are known (see FIXTURES.md).
FIVE = [
    # id, company, place, term, sponsorship, active, date_posted
    ("summer-1", "Google", "Mountain View, CA", "Summer 2026", "Offers Sponsorship", True, 1732000000),
    ("summer-2", "Meta", "Menlo Park, CA", "Summer 2026", "", True, 1731900000),
    ("offseason-1", "Amazon", "Seattle, WA", "Fall 2025", "", True, 1731800000),
    ("old-1", "OldCorp", "Remote", "Summer 2026", "", True, 1700000000),
    ("inactive-1", "InactiveCorp", "Remote", "Summer 2026", "", False, 1732000000),
]


def listing(id, company="C", locations=("Remote",), terms=("Summer 2026",), sponsorship="",
            active=True, visible=True, posted=1732000000):
    return (
        id, company, "Intern", list(locations), list(terms), sponsorship, active, visible,
        f"https://example.com/{id}", posted, posted, "", "",
    )
