"""Word lists of the name domain. All values in this module are fixed values, stated as text."""

# Titles.
HONORIFICS = (
    "mr mister mrs ms miss smt smti shri shree sri km dr doctor prof professor "
    "bhai bhaiya beta master mst baby babu"
).split()

# Generational suffixes.
SUFFIXES = "jr jnr junior sr snr senior ii iii iv 1st 2nd 3rd".split()

# Relationship markers that carry their slash.
SLASH_QUALIFIERS = "s/o d/o w/o w/d h/d h/o s/d m/d f/d b/d c/o m/o f/o".split()

# Relationship markers that are spelled out.
SPELLED_QUALIFIERS = (
    "sonof daughterof wifeof husbandof brotherof motherof fatherof careof wfe husband wife "
    "daughter brother mother father son care"
).split()

# Tokens without information.
NOISE = "and the of".split()

# Letters that compatibility decomposition leaves whole.
LATIN_LETTERS = {
    "ø": "o", "æ": "ae", "ß": "ss", "ł": "l", "đ": "d", "þ": "th", "Ø": "O", "Æ": "Ae", "Þ": "TH",
    "Ł": "L", "Đ": "D", "œ": "oe", "ſ": "s", "š": "s", "Ÿ": "Y", "č": "c", "ď": "d", "ı": "i",
    "İ": "I", "ŋ": "n", "Ŋ": "N", "Ź": "z", "ź": "z",
}

# Spellings of one name, a class a line; the first word names the class unless a name
# stands before a colon.
SPELLING_CLASSES = """
mohammed mohammad muhammad muhammed mohamed mohammud mahmood
ahmed ahmad
sheikh shaikh sheekh shiekh
hussain husain hossen hosain hussein
iqbal ikbal
said syed sayed
ansari anseri
zoya
chatterjee chaterjee chatterji chattopadhyay chattopadhayay
bandyopadhyay bandopadhyay
bhattacharya bhattacherya bhattacharjee bhattayary bhattecharya
banerjee banerji benerjee
mukherjee mookerjee mukherji
chowdhury choudhury chowdhary choudhary chaudhary choudhrie chaudhuri chowdhuri
dey dai de day
bose boose
ghose gose
haldar halder
barman varman
sethi seti
srinivasan shrinivasan sreenivasan srinivasa srinivas
krishnan krishan krsnan kirshan
lakshmi laxmi laksmi lakshmee
padmavathi padmavati padmavathy padmavathie
khan kaan
singh
venkatesh: venkat venkatesh venkateswara venkateswaran venkatesan venkateshwar venkatachalam venkata venkatesu
gowda gauda gowdru gavda gouda
reddy reddi
nair nayar naiyar
iyer iyyer aiyar ayer
pillai pilay
menon memon
naidu naidoo nayidu
deshmukh
joshi jose joshiy
thakur thakoor takur
chawla
sharma sarma sharmma sarmaa
bhat bhaat bhatt bhatta
saxena saksena
srivastava shrivastava sribastava srivastav
agarwal agrawal aggrawal
phatak pathak patak
pandey pandit pande paandey
anil aneel aneil
sunil suneel suneil
suresh surish
ramesh raamesh remesh
vinod vinodh veenod vinaod
jayesh jaysh
manoj manoaj manoh
deepak dipak depak deepakk
prakash parakash
santosh
mangala
sarala
geetha geeta gita
seetha sita seeta
sriram shriram
varadarajan varadaraj varadharajan
balasubramanian balasubramanyan balasubramaniam
venugopal venugopalan
murali
das dass dasa
sri shri sree
"""


def spelling_lexicon(text: str = SPELLING_CLASSES) -> dict[str, str]:
    """spelling -> class; a spelling in two classes is an error."""
    out: dict[str, str] = {}
    for line in filter(None, text.splitlines()):
        name, _, rest = line.rpartition(":")
        words = rest.split()
        for w in words:
            if w in out:
                raise ValueError(f"{w} is in two spelling classes")
            out[w] = name or words[0]
    return out


# Weights of a token's place in a name, and the credits of the token similarity.
FAMILY_WEIGHT, GIVEN_WEIGHT, MIDDLE_WEIGHT = 1.0, 0.85, 0.45
SAME_CLASS_CREDIT = 0.95
INITIAL_CREDIT, OTHER_INITIAL_CREDIT = 0.70, 0.10
PREFIX_CREDIT = 0.85
PHONETIC_CREDIT = 0.55
FEW_SHARED_CREDIT, SHORT_CREDIT = 0.35, 0.5
CHARACTER_WEIGHT = 0.25
ORDER_FLOOR = 0.90
LAST_ORDER, FIRST_ORDER, NO_ORDER = 1.0, 0.85, 0.70
UNDECIDABLE = 0.5

# The phonetic encoder's rules. First what a word's beginning turns into, then patterns
# and their codes.
METAPHONE_BEGINNINGS = {"AE": "E", "GN": "N", "KN": "N", "PN": "N", "WR": "R", "X": "S", "WH": "W"}
METAPHONE_PATTERNS = {
    "TCH": "X", "DGE": "J", "SCH": "SK", "IGH": "I",
    "PH": "F", "GH": "K", "KH": "K", "TH": "T", "CH": "X", "SH": "X", "WH": "W", "CK": "K", "NG": "NG", "QU": "KW",
    "DG": "J", "AE": "E", "OE": "O", "EE": "E", "EA": "E", "IE": "I", "AI": "E", "OA": "O", "OO": "U", "AU": "O",
    "OU": "U", "EI": "E", "EY": "E",
    "A": "E", "B": "B", "C": "K", "D": "T", "E": "E", "F": "F", "G": "K", "H": "", "I": "I", "J": "J",
    "K": "K", "L": "L", "M": "M", "N": "N", "O": "O", "P": "P", "Q": "K", "R": "R", "S": "S", "T": "T",
    "U": "U", "V": "F", "W": "W", "X": "KS", "Y": "Y", "Z": "S",
}
METAPHONE_SILENT_AFTER_VOWEL = "WKY"
