"""Word lists and limits that results depend on."""

ALIAS_PARTICLES = ("은", "는", "이", "가", "을", "를", "와", "과", "의", "에", "로", "으로", "에서", "에게", "도", "만", "께")
POSTPOSITIONS = (
    "으로서", "으로써", "에게서", "한테서", "에서는", "으로는", "로는", "에게는", "한테는", "까지", "부터", "에서", "에게", "한테", "으로", "와", "과", "은", "는", "이", "가", "을", "를", "에", "로", "도", "만", "께",
)
PLACE_SUFFIXES = ("특별자치시", "특별자치도", "특별시", "광역시", "자치시", "자치도", "시", "도", "군", "구", "읍", "면", "동")
ORGANISATION_SUFFIXES = ("제국", "왕국", "황궁", "길드", "협회", "연맹", "문파", "기사단", "경비대", "사단", "여단", "세가", "교", "단", "문", "련", "회", "파", "궁", "관", "당", "각")
STRING_EQUIVALENTS = {"왕궁": "궁", "익일": "다음날", "tomorrow": "nextday"}
SENTENCE_ENDS = ".!?\n。！？…．"
SENTENCE_CLOSERS = ".…'\")]}’”」』》"
ABBREVIATIONS = ("a.m.", "cf.", "co.", "dr.", "e.g.", "etc.", "fig.", "i.e.", "inc.", "jr.", "ltd.", "mr.", "mrs.", "ms.", "no.", "p.m.", "prof.", "sr.", "st.", "u.k.", "u.s.", "vs.")
MOST_CLOSERS = 24
RELATIVE_TIMES = ("다음 날", "그날", "이튿날", "며칠 후", "며칠 뒤", "첫날", "둘째 날", "셋째 날")
NEGATIONS = ("not", "no", "never", "none", "without", "cannot", "can't", "isnt", "isn't")
OPPOSITES = (("alive", "dead"), ("before", "after"), ("older", "younger"), ("inside", "outside"), ("same", "different"))
DEAD_WORDS = ("사망", "죽음", "죽었다", "죽었", "사망함", "사망했다")
ALIVE_WORDS = ("생존", "살아있다", "살아있음", "살아있", "생존중")
#: tag path -> (schema type, slot)
DEFAULT_TAGS = {
    "설정/인물/주인공/나이": ("int", "age"), "설정/인물/주인공/사망여부": ("bool", "death"), "설정/인물/주인공/소속": ("str", "affiliation"), "설정/인물/주인공/직업": ("str", "job"),
    "설정/인물/주인공/재능": ("str", "talent"), "설정/인물/주인공/관계": ("rel", "relation"), "설정/시간": ("time", "time"), "설정/장소": ("loc", "place"), "설정/세계/분위기": ("str", None),
}
#: slot -> words of a tag's path that name it
SLOT_KEYWORDS = {
    "age": ("나이", "연령", "age"), "time": ("시간", "시점", "날짜", "일시", "time", "date"), "place": ("장소", "위치", "place", "location"), "relation": ("관계", "relation"),
    "affiliation": ("소속", "affiliation"), "death": ("사망", "생존", "death", "alive"), "job": ("직업", "클래스", "job", "class"), "talent": ("재능", "특기", "talent"),
}
SCHEMA_SLOTS = {"int": "age", "time": "time", "loc": "place", "rel": "relation", "bool": "death"}
DESCRIPTIVE_SUFFIXES = ("하는", "하던", "되는", "된", "던", "린", "같은", "스러운")
FRONT_MATTER = ("all rights", "produced in korea", "머리말", "프롤로그", "prologue", "차례")
UNSUPPORTED_HEADERS = (r"(?i)^\s*(?:chapter|ch(?:apter)?\.?)\s*\d{1,5}\b", r"^\s*제\s*\d{1,5}\s*장(?:\s|$)", r"^\s*(?:서장|종장|외전|프롤로그|에필로그)(?:\s|$)")

# Fixed values of the extraction rules: words of the grammar and of the gates on what it finds.
#: slot -> words that label it at a line's beginning or before a particle
SLOT_LABELS = {
    "age": ("나이",), "time": ("시간", "시점", "날짜"), "place": ("장소", "위치"), "relation": ("관계",), "affiliation": ("소속",), "job": ("직업", "클래스"), "talent": ("재능",),
}
TOPIC_PARTICLES = ("은", "는", "이", "가")
COPULAS = ("이었다", "였다", "이다", "입니다", "이며", "이고", "이자", "였고", "였으니", "였구나")
KIN = ("아들", "딸", "동생", "형제", "손녀딸", "손자")
TIES = ("사제", "조력자", "배신자")
TITLES = ("황녀", "왕자", "왕녀", "공주")
DEATH_STATEMENTS = ("사망했다", "사망한 상태다", "사망함", "죽었다", "죽었어", "죽었네")
#: A value that begins with one of these words, has one of these later, or ends in one of these endings is a clause, not a name.
LEADING_NOISE = ("그러자", "그리고", "하지만", "그저", "저놈이", "저에게", "이제", "처음")
LOW_SIGNAL_WORDS = ("수", "것", "편", "정도", "경우", "때문", "위해", "위한", "식", "바", "가지")
CLAUSE_ENDINGS = (
    "이었다", "였다", "이다", "했다", "한다", "된다", "됐다", "있다", "없다", "있었다", "없었다", "않았다", "않는다", "아니다", "아니었다", "싶다", "싶소", "겠지", "겠다", "거든", "는데", "지만", "라면", "라고", "라며",
    "일까", "를까", "구나", "나요", "까요", "리라", "않아", "습니다", "됩니다", "합니다", "해요", "예요", "군", "네", "아요", "어요", "으니", "으니까", "여도", "고",
)
NONFINAL_ENDINGS = ("는", "하는", "되는", "했던", "하던", "하며", "하고", "해서", "같은", "있는", "없는", "중인", "에게", "에서", "으로", "까지", "부터", "명의")
#: Endings of a slot's words that describe what follows them, when a head is compared with a longer value.
HEAD_DESCRIPTIVE = ("는", "하는", "되는", "했던", "하던", "하다", "했다", "하며", "하고", "해서", "같은", "있는", "없는", "중인")
#: Words behind a relation that make it the topic of something else.
RELATION_TAILS = ("문제", "사건", "계획", "소문", "이야기", "일", "건", "관련", "기록", "쟁탈전", "토벌")
REPORTED_ENDINGS = ("입니다", "이다", "였다", "이었다", "이었습니다", "이었소", "이었지", "이었네", "이에요", "예요", "라고", "라며", "랍니다", "라네", "이랍니다")
