"""Word lists behind ``string_type`` providers and confusable characters."""

# Entries a provider picks from, one list per provider name.
WORDS = """river stone amber cloud field maple north ocean pilot quiet rapid solar tiger umbra
velvet winter yellow zephyr anchor bridge copper desert ember forest garden harbor island jungle
kernel ladder meadow nectar orchid pepper quartz ribbon silver timber""".split()
FIRST_NAMES = """Ada Ben Clara David Elena Felix Greta Hugo Irene Jonas Karla Leon Maria Noah
Olga Peter Quinn Rosa Simon Tessa Ugo Vera Walter Xenia Yusuf Zoe""".split()
LAST_NAMES = """Adler Brown Castro Dietrich Evans Fischer Garcia Hansen Ivanov Jensen Keller Lopez
Martin Novak Olsen Peters Quist Rossi Smith Turner Ulrich Vogel Weber Young Zimmer""".split()
CITIES = """Amsterdam Bergen Chicago Dublin Edinburgh Florence Geneva Hamburg Istanbul Jakarta
Kyoto Lisbon Madrid Nairobi Oslo Prague Quito Riga Seoul Tbilisi Utrecht Vienna Warsaw Zagreb""".split()
STATES = """Alabama Alaska Arizona California Colorado Florida Georgia Idaho Kansas Maine Nevada
Ohio Oregon Texas Utah Vermont Virginia Wyoming""".split()
MAIL_HOSTS = "example.com example.net example.org".split()


def chars(*points: int) -> str:
    """Characters by code point, for those that cannot be seen in an editor."""
    return "".join(map(chr, points))


# Characters used when text is corrupted on purpose.
REPLACEMENT = chars(0xFFFD)
ZERO_WIDTH = chars(0x200B, 0x200D, 0x200E, 0x200F)  # space, joiner, left-to-right and right-to-left mark
COMBINING = chars(0x0301, 0x0300, 0x0302, 0x0308)  # acute, grave, circumflex, diaeresis
QUOTES_AND_DASHES = chars(0x2018, 0x2019, 0x201C, 0x201D, 0x2013, 0x2014, 0x00B7, 0x30FB)
ODD_SPACES = chars(0x00A0, 0x202F, 0x2009, 0x200A)  # no-break, narrow no-break, thin, hair
BIDI_ISOLATES = chars(0x2066, 0x2067, 0x2068, 0x2069)
CONFUSABLE = QUOTES_AND_DASHES + ODD_SPACES + BIDI_ISOLATES
HOMOGLYPH_FROM = "aeopcxyABCEHIKMNOPSTXYZ"
HOMOGLYPH_TO = chars(  # Cyrillic and Greek letters that look like the ones above
    0x0430, 0x0435, 0x03BF, 0x0440, 0x0441, 0x0445, 0x0443, 0x0391, 0x0392, 0x0421, 0x0395, 0x0397,
    0x0399, 0x039A, 0x039C, 0x039D, 0x039F, 0x03A1, 0x0405, 0x03A4, 0x03A7, 0x03A5, 0x0396)
ASCII_ALNUM = "".join(chr(c) for r in ((48, 58), (65, 91), (97, 123)) for c in range(*r))
FULLWIDTH_ALNUM = "".join(chr(ord(c) + 0xFEE0) for c in ASCII_ALNUM)
FULLWIDTH_DIGITS = FULLWIDTH_ALNUM[:10]
