"""Short texts, and a recogniser, that hold what the tables and this installation lack."""

import re

TEXTS = (
    "SSN 123-45-6789 and 987-65-4321, ITIN 987-75-4321, EIN 12-3456789.",
    "ZIP 94103-1234 or 94110; PIN 560001, 123 456.",
    "Write to a@b. user@company, x.y@z.io. or call (415) 867-5309, 1 415 867 5309.",
    "Card 4111111111111111, not 4532-8891-2234-5567.",
    "ID AB12CD34EF56 and ABCDEFGHIJKL, plate ABC-1234.",
    "Hosts 10.0.0.1 and 256.1.1.1, see https://example.org/a?b=c#d and http://x.example.",
    "Anna Maria Lopez met John Smith in May.\nTotal 12\n34 Main.",
    "",
    "tab\there &amp;lt; &copy; a –b— x@ \n y.org",
    "Name: Ann Lee  Phone: 555-123-4567\nEmail: ann@lee.example\nSSN: 123-45-6789",
)

#: What the recogniser below takes for a person.
PERSON = "[A-Z][a-z]+ [A-Z][a-z]+"


def recogniser():
    """An entity recogniser of a few lines, for the queries that compare what recognisers add."""
    person = re.compile(PERSON)
    return lambda text: [{"start": m.start(), "end": m.end(), "label": "PERSON", "score": 0.85} for m in person.finditer(text)]
