"""Lists, patterns and limits that results depend on. They are stated here as they are; what is done with them is elsewhere."""

from __future__ import annotations

# Names of the playable characters.
CHARACTERS = [
    "Octane", "Bangalore", "Valkyrie", "Bloodhound", "Wraith", "Pathfinder", "Lifeline", "Caustic", "Mirage", "Gibraltar", "Wattson",
    "Crypto", "Revenant", "Loba", "Rampart", "Horizon", "Fuse", "Seer", "Ash", "MadMaggie", "Newcastle", "Vantage", "Catalyst",
    "Ballistic", "Alter", "Conduit",
]

# Words of notices, never a name, not even beside a marker.
NOTICE_WORDS = (
    "spotted pinged enemy enemies reviving broken bleed shield eliminated leader kill kills knocked finisher killer headshot "
    "champion care package loot looted looting contained containing crafting materials items supply upgrades upgrade banner location "
    "suggested revealed map audio area defend avoid attack watch ping hitted level lvl mag extended dibs canceled ring squad "
    "teammate stream unreadable nerf nerfs subscribe fridge samsung crafting akimbo rounds elevator connoisseur connnissaiir lonnolsseur "
    "melee compromise compromised lacation focation beam out revealedl directly clearly gettingt pushed gettingshotun spottedan anenemy"
).split()

# Words that are no name in free text.
EVENT_WORDS = (
    "broken- broken suggested -suggested spotted- spotted location locationd out bleed ring the you enemy shield audio here care package "
    "containing eliminated leader kill new with kills looted that contained has been pinged loot reviving champion are and guy looking people "
    "compromise nerf nerfs compromised lacation focation area over defend avoid this looting from full beam for since fridge samsung subscribe "
    "crafting ready fall akimbo heavy rounds elevator music connoisseur connnissaiir lonnolsseur melee edge sakuras sakurasedge directly "
    "clearly getting gettingt pushed"
).split()

# Tags of broadcasts, never a name.
BROADCAST_TAGS = ["live", "lve", "ttv", "ttok", "twitch", "yt"]

# Kinds of lines that name nobody who was hit.
NO_VICTIM = ["SuggestLocation", "Ping", "Audio", "Scan", "ShieldBroken", "MyShieldBroken", "Eliminated", "LootedCarePackage"]

# Words of banners in which a marker is none, and of lines that never are events.
BANNER = r"revealed|location|supply|spotted|shield|looted|care\s*package"
PROMPT = r"\bentered\b|abilit"

# Shapes of words, markers and parts of a line.
WORD = r"[\[\(]?[A-Za-z0-9_./-]+[\]\)]?"
FREE_WORD = r"[A-Za-z0-9_.\-/\[\]]+"
ICON = r"<\s*(?:kill|gun)[_\s]*icon\s*>|\b(?:gun|kill)icon\b"
BLEED_OUT = r"\[?\s*b[li]ee?d\s*[oqdgc0]?ut\s*\]?"
PACKAGE_OWNER = r"([A-Za-z0-9_.\-/]+):\s*c?are\s+package"
FELL = r"(?:champion\s+)?(.+?)\s+has\s*been\s*[ae]l[il1]m[il1]n"
PINGER = r"([A-Za-z0-9_.\-/]+)\s+pinged"
REVIVED = r"reviving\s*([A-Za-z0-9_.\-/]+)"
REVIVER = r"^([A-Za-z0-9_.\-/]+)\s*:"

# Shortest names, with and without a sign that it is one.
LEAST_NAME, LEAST_CERTAIN_NAME = 4, 3

# Fixed values: (step, pattern, replacement) of misread tags, regardless of letter case.
BRACKETS = [
    ("bleed out", r"\[?\s*b[il]ee?d\s*[oqdgc0]?u[a-z]?\s*\]?", "[Bleed Out]"),
    ("blaed out", r"\[bla?ed\s*out\]", "[Bleed Out]"),
    ("blg", r"\[blg\s", "[Bleed "),
]
PHRASES = [
    ("enemy shield", r"enemy\s+shield\s+broken", "Enemy Shield Broken"),
    ("my shield", r"my\s+shield\s+broken", "My Shield Broken"),
    ("bleed out", r"bleed\s+out", "Bleed Out"),
]

# Fixed values: (step, pattern, replacement) that take a tag, and what else was read into it, off a name.
TAGS = [
    ("bracketed", r"[\[\(\{\|][A-Z0-9]{2,6}[\]\)\}\|]", ""),
    ("misread bracket", r"^I[A-Z0-9]{2,6}[I\]\)]", ""),
    ("in front", r"^[A-Z]{2,6}[_-]", ""),
    ("edges", r"^[-_|\[\](){}]+|[-_|\[\](){}]+$", ""),
    ("several marks", r"[-_]{2,}", "-"),
    ("blanks", r"^\s+|\s+$", ""),
]
NAME_STEPS = [
    ("dots", r"^\.+|\.+$", ""),
    ("mixed-case tag", r"^\[[A-Z][A-Za-z0-9]{2,6}\]", ""),
    *TAGS,
    ("event word", r"[-_]+(?:[sS][uU][gG][gG][eE][sS][tT][eE][dD]|[sS][pP][oO][tT][tT][eE][dD]|[rR][eE][vV][iI][vV][iI][nN][gG]|[pP][iI][nN][gG][eE][dD]).*$", ""),
    ("end marks", r"[-_:@]+$", ""),
    ("doubled", r"^(.{5,})\1$", r"\1"),
]

# Digits that letters of a default label were, and the least likeness of its beginning to a character's name.
LABEL_DIGITS = dict(zip("ilostbgqz", "110518992"))
LABEL = r"([a-z .\-_]{3,}?)[ .\-_]*([a-z0-9]{3,4})(?:[ .\-_]+[a-z0-9]{1,5})?"
LABEL_LIKENESS = 0.6

# Look-alike letters of a name's key, applied to runs of one letter made one.
LOOK_ALIKES = ("e0cd1ltvy869q5", "aoooiiiuubbggs")

# Words that explain a crop instead of transcribing it.
EXPLAINING = ["because", "sorry", "i ", "the image", "this image", "i can", "i see", "note:", "please"]
