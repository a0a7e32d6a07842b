"""The words and patterns that decide what a printed line is.

They are data, not logic: results are right only with these very words. Patterns are in Java's dialect.
"""

# Money
BARCODE = r"^[0-9]{8,}$"
MONEY = r"^-?₩?[0-9]{1,3}(?:,[0-9]{3})+원?$|^-?₩?[0-9]{3,7}원?$"
PLAIN_INT = r"^[0-9]{1,3}$"
FUZZY_FULL = r"(?<![0-9])(-?)[W₩]?([0-9]{1,3}(?:[,.;:'`][0-9]{3})+)(?![0-9])"
FUZZY_SHORT = r"(?<![0-9,.])(-?)[W₩]?([0-9]{1,3})[,.;]([0-9]{2})(?![0-9,.])"
NUMBER = r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+"

# Layout
HANGUL = "[가-힣]"
HEADER_NAME = r"상\s*품\s*명|품\s*명|메\s*뉴"
HEADER_COLUMNS = r"수\s*량|단\s*가|금\s*액"
REGION_END = "소계|합계|과세물품|면세물품|부가세|가액|공급가|봉사료|총구매|총액|주문금액|배달비|총결제|결제금액"
TOTAL_LABEL = "합계|총액|총구매|총결제|결제금액|받을금액|선결제"
TOTAL_LABEL_WEAK = "주문금액"
TENDER_ROW = "포인트|상품권|캐시|기프트|마일리지|예치금"
LABEL_NAME = "판매금액|받은금액|받을금액|거스름|매출표|승인번호|부가세|봉사료|공급가|합계|소계|총액|총구매|과세물품|면세물품|가액"
DISCOUNT_WORD = "할인|말인|합인|에누리|에누ㄹ|쿠폰|특매|D/?C"
DISCOUNT_TOTAL = r"할인금액|합인금액|총할인|할인계|할인액|에누리계|할인\(에누리\)|쿠폰할인|쿠폰말인|할인쿠폰"
DISCOUNT_DECOY = "현재잔액|잔액|배달팁|배달비|배달료|배달요금|배송비|무료배달|바코드|이용권"
FEE_WORD = "(?:배달(?:비|팁|료|요금)|배송비|무료배달)"
FEE_END = FEE_WORD + r"(?:할인|무료|쿠폰)*(?:\([^)]{0,12}\))?[:：]?$"
FEE_QUALIFIER = "기본|합계|할증|추가|거리|할인|무료|쿠폰|포함|금액"
FEE_BREAKDOWN = "기본|할증|추가|거리"
FEE_OFF = "할인|쿠폰|무료"
DELIVERY_WORD = "배달(?:비(?!대면)|팁|료|요금)|배송비|무료배달"
SUB_PREFIX = r"^[-*+└ㄴ>›»▶►▸~]|^\((?:추가|선택|변경|더하기)|^옵션"
STRONG_SUB_MARK = "^[+└ㄴ>›»▶►▸]"
SUB_MARKS = r"^[-*+└ㄴ>›»▶►▸~\s]+"

# Labels
LABEL_DEFINITE = (
    "부가세|부가가치세|과세물품|면세물품|과세물|면세물|공급가액|총상품금액|상품금액|주문금액|주무금액|결제금액|카드결제|간편결제|카드지불|신용카드|계좌이체|현재잔액"
    "|거스름|승인번호|승인금액|일시불|주문번호|청구금액|받을금액|받은금액|내실금액|쿠팡캐시|소계금액|합계금액|적립포인트|받은포인트|할인합계"
)
LABEL_WHOLE = "^(?:(?:받은|적립|사용|보유|잔여|가용)?포인트|과세|면세|부세|가세|부가|합.{0,2}계.?|총액|소계|합계|공급가)$"
LABEL_PROBABLE = "합계|결제|지불|이체|잔액|할부|포인트|카드|금액$|캐시|현금"
LABEL_COLON = "(?:부가|과세|면세|공급|합.?계|결제|지불|이체|잔액|포인트|승인|일시불|개월|번호|청구|받을|받은|내실|거스름|VAT)[^:：]{0,6}[:：]|[:：].{0,8}(?:카드|은행|페이|일시불)"
VAT_WORD = "(?<![A-Za-z])VAT(?![A-Za-z])"
NON_ITEM_WORD = "상품명|품명|메뉴|수량|단가|금액|배달|배송|결제|할인|쿠폰|적립|영수|합계|소계|총액|거래|매출|사업자|전화"
SUMMARY_LINE = r"^(?:면세|과세)\s*물품\s*가액$|^부\s*가\s*세$|^소\s*계$|^합\s*계$|^할인|^봉사료$|^공급가액$"

# Evidence
PAID_LABEL = "결제금액(?!상세)|총결제|결제액|받을금액|카드결제|카드지불|신용카드|승인금액|내실금액|선결제|바로결제|간편결제"
PAID_SECTION = "결제금액상세|결제내역"
EVIDENCE_DISCOUNT = "할인|말인|합인|에누리|쿠폰|특매"
TENDER_WORD = "포인트|상품권|캐시|기프트|마일리지|예치금|선불|현금|머니"
NOT_SPENT = "적립|잔여|가용|보유|예정|발생|누적|잔액"
EVIDENCE_FEE = "배달팁|배달비|배달료|배달요금|배송비"
DELIVERY_RECEIPT = "배달|배민|쿠팡이츠|요기요|땡겨요"
FEE_NOT_FEE = "요청|주소|메모|라이더|문앞|도착|시간|전화|기사|주문서|전표|고객센터|완료|의민족|예정|안내"
PLACEHOLDER = r"^[-–—~=_.,;:'`]{1,6}$"
BROKEN_AMOUNT = r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z,.;']{2,8}$"
MAX_FEE = 15_000

# Names and dates
LINE_NUMBER = r"^([0-9]{1,3})\s*[*.)\-]*\s*(?=[^0-9\s])"
PLACEHOLDERS = {"store_name": ["상호명"], "payment_method": ["카드 또는 현금"], "purchased_at": ["YYYY-MM-DD HH:MM", "YYYY-MM-DD"]}
MIDNIGHT = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[ T]0?0:00(?::00)?$"
PRINTED_MIDNIGHT = r"(?<![0-9:])00\s*:\s*00(?![0-9])|(?:오전|AM|am)\s*12\s*:\s*00(?![0-9])"

# Hangul letters by syllable arithmetic: first consonants, vowels, last consonants (none comes first)
ONSETS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
CODAS = "∅ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"

# Confusable letters of blurred print, by place in the syllable (∅: no last consonant)
ONSET_GROUPS = ["ㅈㅊ", "ㅂㅍ", "ㅁㅂ", "ㄱㅋ", "ㄷㅌ", "ㅅㅆ", "ㅈㅉ", "ㄱㄲ", "ㅇㅎ", "ㄴㄹ"]
VOWEL_GROUPS = ["ㅏㅓ", "ㅗㅜ", "ㅐㅔ", "ㅑㅕ"]
CODA_GROUPS = ["ㅁㅂ", "ㄴㄹ", "ㄱㄲ", "∅ㅇ"]

# Printed dates: with separators (two shapes in one pattern), after a label without separators, in Korean
PRINTED_DATE = (
    r"(?<![\d])(\d{4}|\d{2})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{2})(?:(?!\d)|(?=\d{1,2}\s*:\s*\d{2}))\s*(?:(\d{1,2})\s*:\s*(\d{2})(?!\d))?"
    r"|(?<![\d])(\d{4}|\d{2})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{1})(?!\d)"
)
LABELLED_DATE = (
    r"(?:판\s*매|거\s*래|결\s*제|주\s*문|승\s*인|발\s*행|구\s*매)\s*[일입](?:\s*[자시])?\s*[:：]?\s*"
    r"(20\d{2}|\d{2})(\d{2})(\d{2})(?:(?!\d)|(?=\d{1,2}\s*:\s*\d{2}))(?:\s*(\d{1,2})\s*:\s*(\d{2})(?!\d))?"
)
KOREAN_DATE = r"(?<!\d)(\d{4}|\d{2})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
DATE_LABEL = r"판\s*매\s*[일입]|거\s*래\s*[일입]|[일입]\s*시(?!\s*불)|결\s*제\s*[일입]|주\s*문\s*[일입]|승\s*인\s*[일입]|날\s*짜|발\s*행\s*[일입]|구\s*매\s*[일입]|DATE|Date"
PRINTED_WEEKDAY = r"([월화수목금토일])\s*요\s*일|[\[(]\s*([월화수목금토일])\s*[\])]"
WEEKDAYS = "월화수목금토일"
OLDEST_DAYS = 366 * 8

# Slant of a photo: least distance (px), band, support and angle in degrees
SKEW_MIN_DX, SKEW_BAND, SKEW_MIN_SUPPORT, SKEW_MIN_SHARE, SKEW_MIN_DEG, SKEW_MAX_DEG = 80.0, 0.008, 5, 0.25, 0.8, 12.0

# Option marks as the model writes them, and as they are printed and misread
ITEM_MARKER = r"^[▶►▸>›»└+*~]\s*|^-\s+"
OCR_OPTION_ROW = r"^\s*(?:[ㄴ└#+>›»▶►▸※]|L(?=[가-힣(\[]))\s*(.+)$"
NAME_MARKER = r"^[#ㄴ└+>›»▶►▸※\s]+"
