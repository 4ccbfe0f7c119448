"""Factors, words and thresholds that results depend on."""

from __future__ import annotations

# The ten factors in order, by category, with their keywords.
FACTOR_CATEGORIES = {
    "물리적 특성": ["심미성", "개방성", "감각적 경험", "접근성", "쾌적성"],
    "활동적 특성": ["활동성", "상호작용성"],
    "의미적 특성": ["상징성", "기억 및 선호", "지역 정체성"],
}
FACTOR_ORDER = [f for own in FACTOR_CATEGORIES.values() for f in own]
FACTOR_ENGLISH = ["Aesthetics", "Openness", "Sensory", "Accessibility", "Comfort", "Activity", "Sociability", "Symbolism", "Preference", "Local Identity"]
FACTOR_KEYWORDS = {
    "심미성": ["예쁘", "아름", "감성", "세련", "멋지", "분위기", "인테리어", "디자인", "조명", "사진", "뷰", "아늑"],
    "개방성": ["넓", "개방", "탁 트", "답답하지", "통유리", "창", "채광", "뷰", "테라스", "좌석 간격", "시원", "오픈"],
    "감각적 경험": ["음악", "향", "향긋", "냄새", "질감", "오감", "감각", "소리", "촉감", "색감", "소품", "커피 향"],
    "접근성": ["가깝", "접근", "역", "정류장", "도보", "주차", "찾아가기", "위치", "편리", "이동", "약속 장소"],
    "쾌적성": ["쾌적", "편안", "편하다", "청결", "깨끗", "위생", "온도", "공기", "통풍", "채광", "정돈", "관리"],
    "활동성": ["대화", "업무", "작업", "회의", "공부", "휴식", "모임", "스터디", "오래 머물", "집중", "좌석"],
    "상호작용성": ["교류", "소통", "대화", "친절", "서비스", "친근", "직원", "커뮤니티", "어울리", "유대", "프로그램", "참여"],
    "상징성": ["독특", "유니크", "개성", "컨셉", "브랜딩", "스타일", "상징", "시그니처", "아이덴티티", "특색", "차별"],
    "기억 및 선호": ["다시 방문", "재방문", "또 가고 싶", "기억", "추억", "인상적", "취향", "선호", "마음에 든", "오래 남"],
    "지역 정체성": ["지역", "동네", "마을", "근처", "주변", "랜드마크", "대표", "로컬", "문화", "역사", "특색", "어울린다"],
}
PRESETS = {
    "분위기 좋은 곳": ["심미성", "감각적 경험", "쾌적성"],
    "작업/공부하기 좋은 곳": ["쾌적성", "개방성", "접근성", "활동성"],
    "친구와 대화하기 좋은 곳": ["활동성", "개방성", "쾌적성"],
    "방문이 편한 곳": ["접근성", "개방성", "쾌적성"],
    "전체적으로 균형 잡힌 곳": FACTOR_ORDER,
}
LEGACY_RENAMES = {"형태성": "개방성", "고유성": "상징성", "기억/경험": "기억 및 선호"}
LEGACY_MERGES = {"상호작용성": ("사회성", "참여성")}

# Sentiment hints and the words of the lexicon.
SENTIMENT_VALUES = {"positive": 1.0, "neutral": 0.0, "mixed": 0.0, "negative": -1.0}
POSITIVE_WORDS = ["좋", "만족", "추천", "깔끔", "예쁘", "편안", "친절", "쾌적", "조용", "맛있", "고급", "세련", "감성", "분위기 좋", "뷰가 좋", "채광", "매력", "최고"]
NEGATIVE_WORDS = ["별로", "아쉽", "불편", "시끄", "답답", "부족", "더럽", "지저분", "비싸", "좁", "최악", "불친절", "불만", "오래 기다", "애매", "우울", "정신없"]

# Words that keyword analysis leaves out.
STOP_WORDS = [
    "카페", "너무", "진짜", "정말", "많이", "가서", "먹고", "있는", "하는", "그리고", "그래서", "좋아요", "있어요", "같아요", "맛있어요", "분위기",
    "생각", "느낌", "방문", "곳", "것", "수", "있습니다", "있었", "있고", "있는데", "있어서", "있어", "있음", "좋습니다", "좋았", "좋고", "좋은",
    "좋아", "좋다", "좋음", "맛있습니다", "맛있었", "맛있고", "맛있는", "맛있어", "이거", "그거", "저거", "이것", "그것", "저것", "그런데", "하지만",
    "그러나", "이런", "그런", "저런", "이렇게", "그렇게", "저렇게", "때문", "위해", "통해", "대해", "관련", "따라", "자리", "자리가", "자리도",
    "자리를", "자리에", "매장", "매장이", "매장도", "매장을", "매장에", "사람", "사람이", "사람들", "사람도", "커피", "커피도", "커피를", "커피가",
    "커피는", "음료", "음료도", "음료를", "디저트", "디저트도", "다양한", "다양", "다른", "매우", "아주", "정말로", "있다",
]

# The districts that place names may hold.
DISTRICTS = [
    "종로구", "중구", "용산구", "성동구", "광진구", "동대문구", "중랑구", "성북구", "강북구", "도봉구", "노원구", "은평구", "서대문구", "마포구", "양천구",
    "강서구", "구로구", "금천구", "영등포구", "동작구", "관악구", "서초구", "강남구", "송파구", "강동구",
]

# Thresholds.
SIMILARITY, DEVIATION, NEUTRAL = 0.4, 0.05, 0.5
BLEND_SIMILARITY, BLEND_SENTIMENT, BLEND_CUT = 0.75, 0.25, 0.3
KEYWORD_COPIES, MINUTES_COPIES = 3, 5
EXAMPLES = 4
EARTH_M, DETOUR, WALK_M_PER_MIN = 6_371_000.0, 1.4, 67.0
