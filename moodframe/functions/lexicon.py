"""Small default word tables. All entries are fixed values; pass your own to override."""

from __future__ import annotations

# The NLTK English stop list.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# The stop list of the sentiment cleaner (also the words its counterpart drops).
SENTIMENT_STOP_WORDS = """
a about above after again ain all am an and any are as at be because been before being below
between both by can d did do does doing down during each few for from further had has have having
he her here hers herself him himself his how i if in into is it its itself just ll m ma me more
most my myself now o of on once only or other our ours ourselves out own re s same she shes should
shouldve so some such t than that thatll the their theirs them themselves then there these they
this those through to too under until up ve very was we were what when where which while who whom
why will with won y you youd youll youre youve your yours yourself yourselves
""".split()

# Word pieces the tokeniser leaves behind, dropped by the post cleaner.
LEFTOVER_WORDS = """
're 's 'm 've n't ... `` ' im ca itv - a. dont us could can 'd __ aaron ab zurab zwart zyl ll u
___ ____
""".split()

# Emoticons dropped as whole tokens by the post cleaner.
HAPPY_EMOTICONS = r"""
:-) :) ;) :o) :] :3 :c) :> =] 8) =) :} :^) :-D :D 8-D 8D x-D xD X-D XD =-D =D =-3 =3 :-)) :'-)
:') :* :^* >:P :-P :P X-P x-p xp XP :-p :p =p :-b :b >:) >;) >:-) <3
""".split()

# Fixed values, as above.
SAD_EMOTICONS = r"""
:L :-/ >:/ :S >:[ :@ :-( :[ :-|| =L :< :-[ :-< =\ =/ >:( :( >.< :'-( :'( :\ :-c :c :{ >:\ ;(
""".split()

# Emoticon to word, applied in this order.
EMOTICON_WORDS = {
    ":)": "smile",
    ":-)": "smile",
    ";d": "wink",
    ":-E": "vampire",
    ":(": "sad",
    ":-(": "sad",
    ":-<": "sad",
    ":P": "raspberry",
    ":O": "surprised",
    ":-@": "shocked",
    ":@": "shocked",
    ":-$": "confused",
    ":\\": "annoyed",
    ":#": "mute",
    ":X": "mute",
    ":^)": "smile",
    ":-&": "confused",
    "$_$": "greedy",
    "@@": "eyeroll",
    ":-!": "confused",
    ":-D": "smile",
    ":-0": "yell",
    "O.o": "confused",
    "<(-_-)>": "robot",
    "d[-_-]b": "dj",
    ":'-)": "sadsmile",
    ";)": "wink",
    ";-)": "wink",
    "O:-)": "angel",
    "O*-)": "angel",
    "(:-D": "gossip",
    "=^.^=": "cat",
}

# Noun suffix rules of WordNet's morphy, in rule order.
NOUN_SUFFIXES = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]

# A tiny polarity table for examples and checks; real runs pass their own lexicon.
SAMPLE_POLARITY = {
    "good": 0.7,
    "great": 0.8,
    "happy": 0.8,
    "best": 1.0,
    "new": 0.14,
    "clear": 0.1,
    "free": 0.4,
    "bad": -0.7,
    "sad": -0.5,
    "worst": -1.0,
    "hard": -0.29,
    "cold": -0.6,
    "late": -0.3,
}


def post_cleaner_drops(stop_words=None) -> list[str]:
    """Tokens the post cleaner removes: stop words, leftovers, emoticons."""
    base = ENGLISH_STOP_WORDS if stop_words is None else list(stop_words)
    words = base + LEFTOVER_WORDS + SENTIMENT_STOP_WORDS + HAPPY_EMOTICONS + SAD_EMOTICONS
    return sorted(set(words))
