"""Closed word lists and tables."""

# Results depend on exactly these entries.

ABBREVIATIONS = "mr mrs ms dr prof sr jr st inc ltd corp dept est vs cf approx e.g i.e a.m p.m u.s u.k ph.d m.d b.a m.a".split()
BEFORE_NUMBER = "no fig vol pp op min max ca".split()
DATE_ABBREVIATIONS = "jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun".split()
DATE_WORDS = DATE_ABBREVIATIONS + "january february march april may june july august september october november december".split()
CAPITALIZED_ONLY = "hon rev co".split()
LOWERCASE_ONLY = "ed eds".split()
SENTENCE_STARTERS = """
the a an it its this that these those then there here he she we they you i and but or so if in on at by to for of as my
our your his her their what when where who why how not no yes now also however one some all many most each every after
before because although while since until with without from thus therefore still yet maybe perhaps please both such
other another
""".split()

SYLLABLE_EXCEPTIONS = {
    "simile": 3, "recipe": 3, "epitome": 4, "hyperbole": 4, "apostrophe": 4, "catastrophe": 4, "sesame": 3, "karate": 3,
    "machete": 3, "adobe": 3, "maybe": 2, "acne": 2, "anemone": 4, "finale": 3, "forte": 2, "cafe": 2, "naive": 2,
    "ukulele": 4, "abalone": 4, "minestrone": 4, "aged": 2, "blessed": 2, "cursed": 2, "learned": 2, "beloved": 3,
    "wicked": 2, "naked": 2, "rugged": 2, "ragged": 2, "jagged": 2, "crooked": 2, "sacred": 2, "wretched": 2, "being": 2,
    "doing": 2, "going": 2, "seeing": 2, "fluid": 2, "ruin": 2, "poem": 2, "poet": 2, "quiet": 2, "diet": 2, "riot": 2,
    "science": 2, "client": 2, "giant": 2, "liar": 2, "dial": 2, "trial": 2, "denial": 3, "area": 3, "idea": 3,
    "museum": 3, "real": 1, "really": 2, "friend": 1, "friendly": 2, "business": 2, "busy": 2, "every": 2, "everyone": 3,
    "everything": 3, "evening": 2, "chocolate": 3, "favorite": 3, "different": 3, "interesting": 4, "comfortable": 4,
    "vegetable": 4, "wednesday": 2, "february": 4, "colonel": 2, "restaurant": 3, "camera": 3, "family": 3, "general": 3,
    "several": 3, "natural": 3, "average": 3, "beautiful": 3, "temperature": 4, "people": 2,
}

BE_FORMS = "am is are was were be been being isn't aren't wasn't weren't".split()
INTERVENING = """
not never always often sometimes usually rarely seldom also still already only just now then thus therefore generally
typically largely widely commonly currently recently previously subsequently clearly obviously simply merely partly
fully completely entirely quickly
""".split()
IRREGULAR_PARTICIPLES = """
been begun blown broken brought built bought caught chosen come cost cut done drawn driven drunk eaten fallen felt fought
found flown forgotten frozen given gone grown held hidden hit hurt kept known laid led left lent let lost made meant met
paid put read ridden risen run said seen sold sent set shaken shot shown shut sung sunk sat slept spoken spent split
spread stolen stuck struck sworn swept swum taken taught torn told thought thrown understood woken worn won written lain
bound burnt dealt dug
""".split()
NOT_NOMINALISATIONS = """
nation station question mention condition position section function option portion fiction motion notion ration moment
element document instrument comment segment cement chance dance distance balance finance romance science sentence
audience experience evidence difference reference city quality quantity majority minority university facility business
witness illness darkness wilderness nature future picture culture structure feature measure figure pressure temperature
literature signal animal total material capital metal general several local final normal
""".split()
HEDGES = """
very really quite rather somewhat fairly pretty basically essentially actually literally virtually arguably perhaps maybe
possibly probably seemingly apparently relatively slightly largely mostly generally typically clearly obviously certainly
definitely undoubtedly truly simply just somehow kind sort
""".split()

DEMO_TERMS = "hell ass cum anal sex shot".split()
COLLATERAL = {
    "hell": "hello shell seashell Michelle Mitchell shellfish".split(),
    "ass": "class assassin passage assessment embarrass grass Cassandra".split(),
    "cum": "circumstance document accumulate cucumber incumbent".split(),
    "anal": "analysis analogy canal banal analytical".split(),
    "sex": "Sussex Essex sexton homosexual Middlesex".split(),
    "shot": "shotgun snapshot gunshot buckshot earshot slingshot".split(),
}
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "Х": "x", "У": "y",
    "ο": "o", "Ο": "o", "α": "a", "Α": "a", "ν": "v", "Ν": "n", "ρ": "p", "Ρ": "p", "τ": "t", "Τ": "t", "Ι": "i", "Κ": "k",
    "Μ": "m", "Ε": "e", "Ζ": "z", "Η": "h", "Β": "b",
    "ａ": "a", "ｂ": "b", "ｃ": "c", "ｄ": "d", "ｅ": "e", "ｆ": "f", "ｇ": "g", "ｈ": "h", "ｉ": "i", "ｌ": "l", "ｎ": "n",
    "ｏ": "o", "ｐ": "p", "ｒ": "r", "ｓ": "s", "ｔ": "t", "ｕ": "u", "ｘ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ƒ": "f",
}
LEET = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "1": "i", "!": "i", "|": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z", "€": "e", "£": "l"}
UNLISTED_LOOKALIKES = {"a": "ɑ", "d": "ԁ", "g": "ɡ", "h": "һ", "k": "κ", "l": "ӏ", "m": "м", "n": "ո", "q": "ԛ", "s": "ꜱ", "u": "υ", "w": "ԝ"}
LEET_FOR = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "$", "t": "7", "g": "9", "b": "8"}
HOMOGLYPH_FOR = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "x": "х", "y": "у", "i": "і"}
ACCENT_FOR = {"a": "á", "e": "é", "o": "ø"}
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}\x{00ad}]"

READING_WPM = 238
ALOUD_WPM = 183
MATTR_WINDOW = 50
MTLD_THRESHOLD = 0.72
