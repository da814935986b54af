"""Quality gates on small corpora of our own: precision, false alarms on native prose, safe fixes."""

from hanlens.plans import report, scan

#: (text, the terms that must be found, the text after safe fixes)
CONVERTED = (
    ("這個軟件需要安裝在硬盤上。", {"軟件", "硬盤"}, "這個軟體需要安裝在硬碟上。"),
    ("請把視頻存到U盤。", {"視頻", "U盤"}, "請把影片存到隨身碟。"),
    ("數據庫服務器的帶寬不足。", {"數據庫", "服務器", "帶寬"}, "資料庫伺服器的頻寬不足。"),
    ("他用鼠標點了超鏈接。", {"鼠標", "超鏈接"}, "他用滑鼠點了超連結。"),
    ("這篇博客講人工智能。", {"博客", "人工智能"}, "這篇部落格講人工智慧。"),
    ("字符串的長度以字節計算。", {"字符串", "字節"}, "字串的長度以位元組計算。"),
    ("線程之間異步通信。", {"線程", "異步"}, "執行緒之間非同步通信。"),
    ("打印機需要更換芯片。", {"打印機", "芯片"}, "印表機需要更換晶片。"),
    ("互聯網讓短信變少了。", {"互聯網", "短信"}, "網際網路讓簡訊變少了。"),
    ("意大利與新西蘭的出租車。", {"意大利", "新西蘭", "出租車"}, "義大利與紐西蘭的計程車。"),
    ("這段源代碼用了遞歸。", {"源代碼", "遞歸"}, "這段原始碼用了遞迴。"),
    ("酸奶和土豆都賣完了。", {"酸奶", "土豆"}, "優格和馬鈴薯都賣完了。"),
)
#: Prose as it is written in Taiwan.
NATIVE = (
    "昨天下午下了一場大雨，巷口的水溝都滿了，鄰居出來幫忙清理落葉。", "圖書館週末開放到晚上九點，二樓有安靜的自習室。", "她把資料庫搬到新的伺服器，順便更新了軟體。",
    "這家店的滷肉飯很有名，中午常常要排隊。", "我們搭捷運到淡水，再轉公車上山。", "程式在執行時會配置記憶體，結束後才釋放。", "請把檔案存在隨身碟裡，明天交給老師。",
    "山上的櫻花開了，遊客一早就出門賞花。", "爸爸在院子裡種了番茄和馬鈴薯。", "網路速度變慢的時候，可以重新啟動路由器。", "他在部落格上分享旅行的照片。", "會議延到下週三，請大家留意信箱。",
    "印表機沒有紙了，麻煩補一下。", "老師用投影機播放影片，學生看得很專心。", "這份報告的品質很好，主管很滿意。", "國內存款利率調升，民眾到銀行排隊。", "畢業生並且發展出自己的風格。", "程序員這個詞在台灣比較少見。",
    "弟弟喜歡吃優格，妹妹喜歡喝豆漿。", "外面的天氣很冷，記得多穿一件外套。",
)


def test_gates(spark):
    docs = [(k, t) for k, (t, *_) in enumerate(CONVERTED)] + [(100 + k, t) for k, t in enumerate(NATIVE)]
    gold = [(k, w) for k, (_, words, _) in enumerate(CONVERTED) for w in words]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = scan.scan(d).where("severity <> 'info'")
    m = report.corpus_metrics(found, spark.createDataFrame(gold, "doc_id long, found string"), d).first()
    assert m.precision >= 0.9 and m.recall >= 0.9 and m.false_positive_rate <= 0.05
    fixed = {r.doc_id: r.fixed_text for r in scan.fixed(d).collect()}
    assert sum(fixed[k] == want for k, (*_, want) in enumerate(CONVERTED)) >= 0.85 * len(CONVERTED)


def test_clean_text_has_no_issue(spark):
    clean = spark.createDataFrame(list(enumerate(NATIVE[:5])), "doc_id long, text string")
    assert scan.scan(clean).count() == 0
    assert scan.fixed(clean, "lexical_contextual").where("n_edits > 0").count() == 0
