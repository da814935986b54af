"""A mixed corpus over the driver's documents, as one SQL expression that Spark and DuckDB share.

The driver's texts hold no Chinese, so most rows begin with one of these samples,
by their id, and go on with their whole text; ``KEPT`` residues have no sample.
"""

from __future__ import annotations

SAMPLES = (
    "這個軟件的內存很大,但是線程太多. 用戶界面需要優化!",
    "他說\"這是測試\"然後離開了; 真的嗎? 好(的)。",
    "請見 https://example.org/a?b=1 與 @writer_1 的說明, 內存在此。",
    "<!-- hanlens:ignore-next-line -->\n這一行的內存不算。\n下一行的內存要算。",
    "蘋果，香蕉，橘子，西瓜，這些水果都很好吃，因為它們新鮮而且價格便宜。",
    "他用“引號”和‘單引號’寫作,大約3~五天,第一-第二章。",
    "等一下...我想想。。。好吧… 共有１２３個。。",
    "我們用Python寫程式,共有3個API和GPT模型。 中文 ，標點 。",
    "重複重複的詞很多，很多的的問題。 the the word word is here.",
    "A I 與 G P U 以及 U S A 都要合併。",
    "你是不是要去台北嗎？我們有沒有時間嗎？他是不是好人。",
    "我吃了和他一起走。天氣是冷。她是漂亮。他是非常高興。",
    "我們強調在品質，討論關於預算，影響到結果。我們進行討論，加以分析，做出決定。",
    "我們對資料進行分析，對系統進行了測試。根據報告顯示，成本下降。根據說明書操作。",
    "這意味著系統會失敗，因此需要修正。所謂快取意味著暫存。作為系統的核心，它擁有模組。",
    "這個方法被廣泛使用，也被廣泛採用。這樣的故事告訴我們要努力。領先業界5年。",
    "值得注意的是，這不只是工具，而是平台。讓我們拭目以待。奠定了理論基礎。",
    "儘管面臨許多挑戰，產業仍然成長。從設計到測試再到部署都要自動化。",
    "價格的下降導致需求上升。我明天會去台北找老朋友，如果不下雨的話。他是一個善良的人。",
    "他仔細的看書，慢慢地走路。我的朋友的父親的公司的產品的價格很高。",
    "他來了。他走了。他笑了。她哭了。2020年他曾經去過，已經看了。",
    "這是最美麗的城市之一。因為下雨，所以不去。當我到家的時候，雨停了。",
    "制度的實施的改善的提升很重要。實際上他基本上不懂。絕對地沒問題。",
    "问题很严重,软件的内存不够,这个线程会导致错误。",
    "可以說是相對而言比較好。零​寬字元。挑戰與機遇並存。",
    "第一段在這裡。\n\n第二段也在這裡，內容比較長。\r\n\r\n第三段。",
    "# 挑戰與未來展望\n\n- **效能**：很好\n- **品質**：很好\n- **成本**：很低\n\n內文——補充——結束。",
    "title: 標題 內存\nname: \"線程\"\n# 註解\nlist:\n  - 用戶",
    "他參加了會議,提出優化方案。javascript 和 Github 以及 MYSQL 是名稱。",
    "",
    "嗯，就是說這個東西其實很好用啦，然後那個基本上就對不對。",
    "快速、高效、穩定的平台。這條路線連接過去，這條線會走出來，這條線延伸到未來。",
    "| 項目開發 | 內存 |\n|---|---|\n| 軟件 | 支持系統 |\n\n「外『內』外」與『單獨』，還有「沒關上。",
    "---\ntitle: \"內存 標題\"\ntags: 軟件\n---\n::: note\n軟件在此。\n:::\n\n    縮排 內存\n\n> 引用 線程\n\n`內存` 與 <b>軟件</b>",
    "<!-- hanlens:ignore-block -->\n內存\n軟件\n<!-- hanlens:end-ignore -->\n線程 // hanlens:ignore\n硬件",
    "進程的排程需要PID，多個進程一起跑。學習進程需要耐心。程序編譯成執行檔。令牌用OAuth認證。令牌在區塊鏈上。中間件處理HTTP。",
    "換言之，這意味著失敗。這意味著很多。系統作為核心，程式充當橋樑，他有所作為。使用者擁有權限，擁有者擁有API介面。",
    "我昨天在城裡遇到的朋友送的書很好，這本由許多優秀的作者共同完成的關於程式設計的經典的著作值得一讀。",
    "因為天氣不好。所以我們沒去。雖然很累！但是值得。系統的實施帶來效率的提升，方法的分析的講解，制度的改善與環境的改善。",
    "實際上，他基本上絕對地相信。基本上 (basically) 是這樣。制度的減少在過去這麼多年的發展之中最後導致了失敗。",
    "- **效能提升**：很好\n- **品質改善**：很好\n- **成本下降**：很低\n\n1. **甲**說明\n2. **乙**說明\n3. **丙**說明\n\n- 一\n- 二\n- 三",
    "這是café與naïve的é測試，ｶﾞ與가的內存。Dr. Wang left. He said hi. 中文。etc. Then more? Yes! 好嗎？",
    "共有１２３4個。甲 - 乙。價格 = ...元。// 註解...好\n第一章.....3。東京 ~ 大阪。好…。",
    "祖國的內地有大陸同胞。裏面的着色羣組眞好，綫上帳單。他是高興的，她是漂亮了。",
    "我愛你你。謝謝，哈哈。天天向上。測試測試一下。這個 這個。我們的的書。是是非非。",
)
KEPT = 4
#: Longer documents for rules about density and paragraphs.
RICH = (
    "\n\n".join(f"這意味著第{n}點不容忽視，它深刻影響了結果，從某種意義上說也是如此，從某種程度上說更是這樣。需要注意的是，在某種程度上我們都會改變，在這個過程中學習" for n in "一二三四五六七八九"),
    "\n\n".join(f"雖然第{n}次測試失敗了，但是團隊沒有放棄，值得注意的是，更重要的是大家學到了經驗。不僅速度很快，也更穩定——真的很好——非常好——這證明了努力是成功的關鍵" for n in "一二三四五六七八"),
    "\n\n".join(["# 挑戰與未來展望", "## 結論與展望", "- **效能**很好而且**品質**很好，價格也低", "- 第二項說明", "- 第三項說明", "1. 第四項說明"]),
    "他被批評，被責罵，被忽視，被開除，被遺忘，被嘲笑，然後離開了那個地方再也沒有回來過。\n\n可以說是相對而言在某種程度上這個結果還算可以接受，從某個角度來看它可以說是相對而言非常成功的一次嘗試，值得大家一起學習參考與討論。",
    "快速、高效、穩定、可靠。努力學習，天天向上。\n\n努力學習，天天向上。我們要進步、要創新。",
    "這是台灣最大的公司之一，也是全世界最有名的品牌之一，更是消費者最喜歡的廠商之一，它的產品在市場上受到許多人的歡迎和支持，銷售量每年都有成長，員工人數也持續增加，未來還會繼續擴大規模，服務更多不同的客戶，並且在各地設立新的據點與研發中心，培養更多人才。",
)


def _literal(text: str) -> str:
    parts = []
    for line in text.replace("\r\n", "\x00").split("\n"):
        inner = " || chr(13) || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in line.split("\x00"))
        parts.append(inner)
    return " || chr(10) || ".join(parts)


def _before(cases: str, divisor: int, column: str) -> str:
    return f"coalesce(CASE doc_id % {divisor} {cases} END || chr(10) || chr(10), '') || coalesce({column}, '')"


def text_sql(column: str = "text") -> str:
    """A document's whole text with its sample before it, in either dialect."""
    cases = " ".join(f"WHEN {k} THEN {_literal(s)}" for k, s in enumerate(SAMPLES))
    return _before(cases, len(SAMPLES) + KEPT, column)


def long_sql(column: str = "text") -> str:
    """Longer samples: twelve in a row, as paragraphs, or a rich one, before the whole text."""
    k = len(SAMPLES)
    cases = " ".join(f"WHEN {n} THEN {' || chr(10) || chr(10) || '.join(_literal(SAMPLES[(n * 5 + j * (1 + n % 3)) % k]) for j in range(12))}" for n in range(k))
    rich = " ".join(f"WHEN {k + KEPT + n} THEN {_literal(t)}" for n, t in enumerate(RICH))
    return _before(f"{cases} {rich}", k + KEPT + len(RICH), column)
