"""The rule tables: a seed lexicon, casing rules, collocations and priors.

The seed, some 170 terms, is smaller than a full regional dictionary; packs and
overrides extend it (``operators.dictionary.layered``, ``sources.files.read_rules``).  Fixed values, one rule a line:
from | to (comma-separated, empty: delete, ``-``: advise only) | type | English |
exceptions | context clues | negative clues | positional clues | context
"""

from __future__ import annotations

from typing import NamedTuple

SEED = """
軟件|軟體|cross_strait|software||||
硬件|硬體|cross_strait|hardware||||
內存|記憶體|cross_strait|memory|國內存款|||
線程|執行緒|cross_strait|thread||||
進程|行程,處理程序,進度|cross_strait|process|||和平|
用戶界面|使用者介面|cross_strait|user interface||||
用戶|使用者|cross_strait|user|用戶端|||
界面|介面|cross_strait|interface||||
優化|最佳化|cross_strait|optimization||||
程序|程式|cross_strait|program|程序員,處理程序|||法律
程序員|程式設計師|cross_strait|programmer||||
默認|預設|cross_strait|default||||
支持|支援|cross_strait|support||系統,功能,版本||
服務器|伺服器|cross_strait|server||||
數據庫|資料庫|cross_strait|database||||
數據|資料|cross_strait|data|數據機|||
信息|資訊|cross_strait|information||||
網絡|網路|cross_strait|network||||
視頻|影片|cross_strait|video||||
質量|品質|cross_strait|quality||||物理
文件|檔案|cross_strait|file||目錄,路徑||before:公文
打印|列印|cross_strait|print||||
鼠標|滑鼠|cross_strait|mouse||||
屏幕|螢幕|cross_strait|screen||||
緩存|快取|cross_strait|cache||||
接口|介面|cross_strait|interface||||
宏|巨集|cross_strait|macro||編譯,展開||
聲明|宣告|cross_strait|declare||變數,函式||
運行|執行|cross_strait|run||程式,指令||
保存|儲存|cross_strait|save||檔案,設定||
土豆|馬鈴薯|cross_strait|potato||||
出租車|計程車|cross_strait|taxi||||
公交車|公車|cross_strait|bus||||
地鐵|捷運|cross_strait|metro||||after:台北
的的|的|typo|||||
因該|應該|typo|should||||
在見|再見|typo|goodbye||||
必需|必須|confusable|must||||
帳單|賬單|variant|bill||||
裡面|裏面|variant|inside||||
綫|線|variant|line||||
台灣省|台灣|political_coloring|Taiwan||||
內地|中國|political_coloring|mainland China||||
祖國|-|political_coloring|||||
值得注意的是，||ai_filler|||||
總的來說，||ai_filler|||||
眾所周知|-|ai_filler|||||
作為一個|-|translationese|as a||||
硬盤|硬碟|cross_strait|hard disk||||
光盤|光碟|cross_strait|optical disc||||
U盤|隨身碟|cross_strait|USB flash drive||||
鍵盤快捷鍵|鍵盤快速鍵|cross_strait|keyboard shortcut||||
打印機|印表機|cross_strait|printer||||
芯片|晶片|cross_strait|chip||||not_before:薯
外設|週邊設備|cross_strait|peripheral||||adjacent:連接
智能|智慧|cross_strait|smart||||
人工智能|人工智慧|cross_strait|artificial intelligence||||
機器學習算法|機器學習演算法|cross_strait|machine learning algorithm||||
算法|演算法|cross_strait|algorithm|計算法||口算|
變量|變數|cross_strait|variable|變量程||化學|
常量|常數|cross_strait|constant|非常量力||微量|
函數|函式|cross_strait|function||程式,呼叫,參數|三角,微積分|
數組|陣列|cross_strait|array|多數組織,數組成|||
字符串|字串|cross_strait|string||||
字符|字元|cross_strait|character||||
字節|位元組|cross_strait|byte||||
比特|位元|cross_strait|bit|比特幣|||
指針|指標|cross_strait|pointer||記憶體,位址,程式|時鐘|
對象|物件|cross_strait|object||類別,實例,程式|結婚|
實例|執行個體|cross_strait|instance||類別,物件||
接入|存取|cross_strait|access||||
訪問|存取,瀏覽|cross_strait|access||資料,網站,檔案|記者|
遍歷|走訪|cross_strait|traverse||||
調用|呼叫|cross_strait|call|調用途|||
返回值|回傳值|cross_strait|return value||||
異步|非同步|cross_strait|asynchronous|差異步驟|||
並發|並行|cross_strait|concurrent|並發現,並發展,並發生|||
隊列|佇列|cross_strait|queue||訊息,資料,程式|軍隊,閱兵|
堆棧|堆疊|cross_strait|stack||||
哈希|雜湊|cross_strait|hash||||
循環|迴圈|cross_strait|loop||程式,變數,語法|血液,水|
遞歸|遞迴|cross_strait|recursion||||
拷貝|複製|cross_strait|copy||||
粘貼|貼上|cross_strait|paste||||
剪切|剪下|cross_strait|cut||檔案,文字||
刷新|重新整理|cross_strait|refresh||頁面,畫面|紀錄|
登錄|登入|cross_strait|log in||帳號,密碼||
註銷|登出|cross_strait|log out||帳號||
賬號|帳號|cross_strait|account||||
賬戶|帳戶|cross_strait|account||||
鏈接|連結|cross_strait|link||||
超鏈接|超連結|cross_strait|hyperlink||||
郵箱|信箱|cross_strait|mailbox||||
短信|簡訊|cross_strait|text message|簡短信件|||
博客|部落格|cross_strait|blog|賭博客人|||
微博客|微網誌|cross_strait|microblog||||
帖子|貼文|cross_strait|post|請帖子|||
手機號|手機號碼|cross_strait|phone number||||
移動設備|行動裝置|cross_strait|mobile device||||
移動端|行動端|cross_strait|mobile||||
設備|裝置|cross_strait|device||手機,電腦,連線||
攝像頭|攝影機|cross_strait|camera||||
分辨率|解析度|cross_strait|resolution||||
像素|畫素|cross_strait|pixel||相機,螢幕||
帶寬|頻寬|cross_strait|bandwidth||||
寬帶|寬頻|cross_strait|broadband||||
局域網|區域網路|cross_strait|LAN||||
互聯網|網際網路|cross_strait|Internet||||
路由器配置|路由器設定|cross_strait|router configuration||||
服務端|伺服端|cross_strait|server side||||
客戶端|用戶端|cross_strait|client||||
中間件|中介軟體,中介層|cross_strait|middleware||||
令牌|權杖,代幣,詞元|cross_strait|token||認證,OAuth,JWT,區塊鏈,加密貨幣,NLP,分詞|象棋|
代碼|程式碼|cross_strait|code|代碼頭||股票|
源代碼|原始碼|cross_strait|source code||||
開源|開放原始碼|cross_strait|open source|展開源頭|||
調試|除錯|cross_strait|debug||||
編程|程式設計|cross_strait|programming||||
宏定義|巨集定義|cross_strait|macro definition||||
模塊|模組|cross_strait|module||||
組件|元件|cross_strait|component||||
插件|外掛|cross_strait|plug-in||||
補丁|修補程式|cross_strait|patch||||
日誌|記錄檔|cross_strait|log||系統,伺服器||
交互|互動|cross_strait|interaction|外交互惠|||
項目|專案|cross_strait|project||開發,團隊,管理|檢查|
高清|高畫質|cross_strait|high definition||||
音頻|音訊|cross_strait|audio||||
投影儀|投影機|cross_strait|projector||||
激光|雷射|cross_strait|laser||||
傳感器|感測器|cross_strait|sensor||||
集成電路|積體電路|cross_strait|integrated circuit||||
電子表格|試算表|cross_strait|spreadsheet||||
幻燈片|投影片|cross_strait|slide||||
菜單|選單|cross_strait|menu||程式,點選,畫面|餐廳|
窗口|視窗|cross_strait|window||程式,畫面,滑鼠|售票|
文檔|文件|cross_strait|document||||
文件夾|資料夾|cross_strait|folder||||
目錄樹|目錄樹狀結構|cross_strait|directory tree||||
複印|影印|cross_strait|photocopy||||
公交|公車|cross_strait|bus|公交車,外交|||
自行車|腳踏車|cross_strait|bicycle||||not_after:共享
摩托車|機車|cross_strait|motorcycle||||
幼兒園|幼稚園|cross_strait|kindergarten||||
酸奶|優格|cross_strait|yogurt||||
方便面|泡麵|cross_strait|instant noodles||||
奧特曼|超人力霸王|cross_strait|Ultraman||||
新西蘭|紐西蘭|cross_strait|New Zealand||||
意大利|義大利|cross_strait|Italy|注意大利|||
老撾|寮國|cross_strait|Laos||||
以經|已經|typo|already|可以經,所以經|||
在次|再次|typo|again|存在次,現在次|||
渡假|度假|typo|vacation||||
布署|部署|typo|deploy||||
反應問題|反映問題|confusable|report a problem||||
做法|作法|confusable|approach||寫作,文章||
台|臺|variant|||||
羣|群|variant|crowd||||
着|著|variant|||||
眞|真|variant|true||||
大陸同胞|-|political_coloring|||||
不可否認的是，||ai_filler|||||
總而言之，||ai_filler|||||
在當今社會，||ai_filler|||||
毫無疑問，||ai_filler|||||
對於...來說|-|translationese|for||||
之所以如此|-|translationese|the reason is||||
""".strip()

CASES = ("JavaScript|", "GitHub|", "MySQL|MariaDB", "Python|", "TypeScript|", "PostgreSQL|Postgres", "iOS|", "macOS|", "YouTube|", "LaTeX|TeX")
SEVERITY = {"political_coloring": "error", "typo": "error", "cross_strait": "warning", "confusable": "warning", "variant": "warning", "ai_filler": "info", "translationese": "info"}
SEVERITY_ORDER = {"info": 0, "warning": 1, "error": 2}
TYPE_ORDER = {t: k for k, t in enumerate(("cross_strait", "political_coloring", "typo", "confusable", "variant", "case", "punctuation", "grammar", "repetition", "ai_style", "translationese"))}
#: Terms of the stance gate that an international stance lets pass.
INTERNATIONAL_ONLY = ("內地", "大陸同胞", "祖國")
#: (from, word nearby, resolves to); the first one whose word is there counts
COLLOCATIONS = (
    ("進程", "排程", "行程"), ("進程", "PID", "行程"), ("進程", "行程表", "行程"), ("進程", "殺掉", "行程"), ("進程", "前景", "行程"),
    ("進程", "背景", "行程"), ("進程", "調度", "行程"), ("進程", "fork", "行程"), ("進程", "exec", "行程"), ("進程", "daemon", "行程"),
    ("程序", "編譯", "程式"), ("程序", "原始碼", "程式"), ("程序", "執行檔", "程式"), ("程序", "除錯", "程式"), ("程序", "偵錯", "程式"),
    ("程序", "compiler", "程式"), ("程序", "binary", "程式"),
    ("線程", "多執行緒", "執行緒"), ("線程", "mutex", "執行緒"), ("線程", "鎖", "執行緒"), ("線程", "並行", "執行緒"), ("線程", "並發", "執行緒"), ("線程", "同步", "執行緒"),
    ("內存", "分配", "記憶體"), ("內存", "配置", "記憶體"), ("內存", "洩漏", "記憶體"), ("內存", "堆疊", "記憶體"), ("內存", "heap", "記憶體"),
    ("內存", "stack", "記憶體"), ("內存", "malloc", "記憶體"), ("內存", "RAM", "記憶體"),
    ("軟件", "安裝", "軟體"), ("軟件", "更新", "軟體"), ("軟件", "版本", "軟體"), ("軟件", "下載", "軟體"),
    ("硬件", "驅動", "硬體"), ("硬件", "晶片", "硬體"), ("硬件", "主機板", "硬體"),
    ("接口", "API", "介面"), ("接口", "使用者", "介面"), ("接口", "圖形", "介面"), ("接口", "USB", "介面"),
    ("服務器", "HTTP", "伺服器"), ("服務器", "網路", "伺服器"), ("服務器", "部署", "伺服器"), ("服務器", "雲端", "伺服器"),
    ("鏈接", "網址", "連結"), ("鏈接", "URL", "連結"), ("鏈接", "超連結", "連結"),
    ("令牌", "OAuth", "權杖"), ("令牌", "JWT", "權杖"), ("令牌", "認證", "權杖"), ("令牌", "區塊鏈", "代幣"), ("令牌", "加密貨幣", "代幣"),
    ("令牌", "NLP", "詞元"), ("令牌", "分詞", "詞元"), ("令牌", "tokenizer", "詞元"),
    ("中間件", "HTTP", "中介層"), ("中間件", "路由", "中介層"), ("中間件", "Express", "中介層"),
)
#: profile: (from, preferred, weight)
PRIORS = {
    "base": (
        ("進程", "行程", 0.3), ("線程", "執行緒", 0.3), ("內存", "記憶體", 0.3), ("軟件", "軟體", 0.3),
        ("硬件", "硬體", 0.3), ("接口", "介面", 0.3), ("服務器", "伺服器", 0.3), ("程序", "程式", 0.2),
    ),
    "strict": (
        ("進程", "行程", 0.5), ("線程", "執行緒", 0.5), ("內存", "記憶體", 0.5), ("軟件", "軟體", 0.5), ("硬件", "硬體", 0.5), ("接口", "介面", 0.5),
        ("服務器", "伺服器", 0.5), ("程序", "程式", 0.4), ("令牌", "權杖", 0.3), ("中間件", "中介層", 0.4),
    ),
}
#: Words around 進程 that show another sense.
OTHER_SENSES = {"進程": ("學習", "成長", "改革", "歷史", "發展", "進展", "過程", "耐心", "毅力")}

#: Function words, which segmentation favours.
STOP_WORDS = (
    "我", "你", "他", "她", "它", "我們", "你們", "他們", "自己", "這", "那", "這個", "那個", "這些", "那些", "這裡", "那裡",
    "的", "了", "著", "過", "嗎", "呢", "吧", "啊", "呀", "啦", "在", "把", "被", "讓", "給", "跟", "和", "與", "或", "但", "而",
    "因為", "所以", "如果", "雖然", "但是", "而且", "或者", "不過", "是", "有", "沒有", "會", "能", "可以", "要", "應該", "不",
    "去", "來", "做", "用", "說", "看", "想", "知道", "很", "太", "非常", "都", "也", "就", "才", "又", "再", "已經", "正在",
    "一直", "還", "更", "最", "個", "位", "件", "條", "種", "些", "每", "各", "多", "少", "人", "時候", "地方", "東西", "問題",
    "方法", "情況", "結果", "時間", "工作", "國家", "公司", "系統", "技術", "使用",
    "一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "百", "千", "萬",
)
#: A seed of general words that a term's edges must not cut; a full word list is a parameter of ``Segmenter``.
VOCABULARY = (
    "概念", "方式", "過程", "關係", "部分", "功能", "內容", "目的", "能力", "經驗", "影響", "效果", "需求", "條件", "原因", "基礎", "標準", "範圍",
    "程度", "價值", "意義", "規則", "機制", "領域", "狀態", "事件", "資源", "環境", "結構", "活動", "理論", "策略", "方案", "目標", "任務", "責任",
    "制度", "組織", "目前", "之後", "之前", "現在", "以前", "以後", "未來", "同時", "階段", "其中", "之間", "內部", "外部", "提供", "包含", "處理",
    "進行", "開始", "完成", "建立", "設定", "選擇", "表示", "認為", "發現", "決定", "解決", "產生", "實現", "管理", "保持", "改變", "增加", "減少",
    "獲得", "接受", "執行", "分析", "研究", "討論", "考慮", "存在", "成為", "需要", "希望", "注意", "準備", "避免", "發展", "設計", "測試", "定義",
    "比較", "維護", "確認", "推動", "主要", "重要", "基本", "一般", "相關", "不同", "特別", "可能", "經常", "其實", "幾乎", "至少", "正確", "完整",
    "有效", "直接", "自動", "例如", "此外", "然而", "因此", "根據", "透過", "對於", "關於", "隨著", "除了", "包括", "即使", "尤其", "首先", "最後",
    "程序員", "大陸", "陸地", "內存款", "數據機", "並且", "國內", "界面", "水面",
)


class Rule(NamedTuple):
    rule_id: int
    from_: str
    to: tuple[str, ...]
    type: str
    english: str | None = None
    exceptions: tuple[str, ...] = ()
    clues: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    positional: tuple[str, ...] = ()
    disabled: bool = False
    context: str | None = None


def parse(table: str = SEED) -> list[Rule]:
    def some(field: str) -> tuple[str, ...]:
        return tuple(x for x in field.split(",") if x)

    rules = []
    for k, line in enumerate(table.splitlines()):
        f = [*line.split("|"), *[""] * 8]
        to = () if f[1] == "-" else tuple(f[1].split(","))
        rules.append(Rule(k, f[0], to, f[2], f[3] or None, some(f[4]), some(f[5]), some(f[6]), some(f[7]), False, f[8] or None))
    return rules
