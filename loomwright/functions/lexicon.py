"""Small word lists written for this package, and the fixed domain lists that results depend on."""

from __future__ import annotations

STOP_WORDS = {
    "en": "a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how i if in into is it its just me more my no not of on one only or other our out over she so some such than that the their them then there these they this those to up us was we were what when which who will with would you your".split(),
    "de": "aber als am an auch auf aus bei bin bis da das dass dem den der des die dir doch du ein eine einem einen einer er es hat ich ihm ihn ihr im in ist ja kann man mein mich mir mit nach nicht noch nur oder sich sie sind so um und uns vom von vor war was wenn wie wir zu zum zur".split(),
    "es": "a al como con de del desde donde el ella ellas ellos en entre era es esa ese eso esta este esto ha hasta la las le les lo los me mi mis muy nada ni no nos o para pero por que se ser si sin sobre son su sus te ti tu un una uno y ya yo".split(),
    "fr": "a au aux avec ce ces cette dans de des du elle elles en et eux il ils je la le les leur lui ma mais me mes moi mon ne nos notre nous on ou par pas plus pour qu que qui sa sans se ses son sur ta te tes toi tu un une vos votre vous".split(),
}
LANGUAGES = sorted(STOP_WORDS)

#: Words that the keyphrase filter leaves out besides stop words.
KEA_DOMAIN = """
cc bcc po tel fax am pm n't etc 've 'll thanks thank tkx thx sorry regards luck wish wishes hello bye disposal
forward forwards forwarded dear hi fyi let lets get gets got please pls need needs average sum
monday mon tuesday tue wednesday thursday thu friday fri saturday sat sunday
january jan february feb march mar april apr june jun july jul august aug september sep october oct november nov december dec
second seconds minute minutes hour hours day days week weeks month months year years total all kwh mw
src img gif div bgcolor html serif href font nbsp sansserif know knows knew understand understands doubt doubts web enron
""".split()
#: Words that drop a topic phrase besides stop words. "tuesdafy" is a slip that results depend on: Tuesday stays.
LDA_DOMAIN = """
cc bcc po tel fax am pm n't etc luck wish wishes hello bye disposal thanks fyi regards sorry wish date
monday mon tuesdafy tue wednesday thursday thu friday fri saturday sat sunday
january jan february feb march mar april apr june jun july jul august aug september sep october oct november nov december dec
second seconds minute minutes hour hours day days week weeks month months year years total all
src img gif div bgcolor html serif href font nbsp
""".split()

KEA_STOP = sorted({*STOP_WORDS["en"], *KEA_DOMAIN})
LDA_STOP = sorted({*STOP_WORDS["en"], *LDA_DOMAIN})

#: The last stage of the tagger: the first rule that a word matches gives its tag. Fixed values.
SUFFIX_TAGS = [
    (r"^-?[0-9]+(.[0-9]+)?\z", "CD"),
    (r"ould\z", "MD"),
    (r"ing\z", "VBG"),
    (r"ed\z", "VBD"),
    (r"ness\z", "NN"),
    (r"ment\z", "NN"),
    (r"ful\z", "JJ"),
    (r"ious\z", "JJ"),
    (r"ble\z", "JJ"),
    (r"ic\z", "JJ"),
    (r"ive\z", "JJ"),
    (r"est\z", "JJ"),
    (r"^a\z", "PREP"),
]

#: The unigram stage: closed-class words and a few common open ones, by tag.
WORD_TAGS = {
    "DT": "the this that these those an each every some any no",
    "IN": "of in on at by for with from into over under after before about between through during than as if because while",
    "CC": "and or but nor",
    "PRP": "i you he she it we they me him her us them",
    "PP$": "my your his its our their",
    "TO": "to",
    "MD": "can will may must shall might",
    "BE": "is are was were be been being am",
    "WDT": "which what who whom whose when where why how",
    ".": ". ! ? ;",
    ",": ",",
    ":": ": - --",
    "NN": "network system model data time work house market water light paper company power energy price gas contract report plan team project service customer group",
    "NNS": "networks systems models people prices contracts reports plans teams projects services customers groups",
    "JJ": "new good high small large great long early young important public same able optical big",
    "VB": "make take give find use work go come see think look want say tell ask",
}
TAG_OF_WORD = {w: tag for tag, words in WORD_TAGS.items() for w in words.split()}
