"""Actions for article pairs, their explanations and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Actions with name, description, priority, least similarity, conditions, steps, timeline, recommended similarity, benefits
ACTIONS = [
    ("MERGE_CONTENT", "統合", "記事の内容がほぼ同じです。重複を解消するため、2つの記事を1つに統合することを強く推奨します。", 100, 0.92, "類似度95%以上+一致率50%以上 または 類似度92%以上+一致率30%以上+同講座", ["両記事の詳細な内容分析", "統合後の記事構成設計", "重複部分の整理と独自部分の統合", "SEOキーワードの最適化", "新記事の作成と公開", "301リダイレクトの設定", "内部リンクの更新"], "2-4週間", 0.94, ["ページビューの統合による順位向上", "重複コンテンツの解消", "ユーザー体験の向上", "サイト全体の権威性向上"]),
    ("REDIRECT_301", "リダイレクト", "記事の内容が非常に似ています。SEO評価を統合するため、アクセス数の少ない記事から多い記事への301リダイレクトを推奨します。", 80, 0.85, "類似度90%以上 または 類似度88%以上+一致率20%以上+同講座 または 類似度85%以上+同講座", ["リダイレクト先記事の内容確認・補強", "301リダイレクトの実装", "Search Consoleでの監視設定", "内部リンクの更新", "リダイレクト効果の測定"], "1-2週間", 0.8, ["リンクジュースの統合", "インデックス効率の向上", "ユーザーの迷いの解消", "サイト構造の最適化"]),
    ("CROSS_LINK", "相互リンク", "記事同士が関連性を持っています。読者の利便性向上のため、記事間の相互リンクを設置することを推奨します。", 60, 0.70, "類似度75%以上 または 類似度70%以上+一致率15%以上", ["相互リンク箇所の特定", "自然なアンカーテキストの作成", "リンクの実装", "クリック率の監視", "ユーザー行動の分析"], "1週間", 0.7, ["サイト滞在時間の向上", "ページビューの増加", "サイト全体の権威性向上", "ユーザーエンゲージメント向上"]),
    ("REVIEW", "レビュー", "記事の内容に類似点がありますが、差別化の余地があります。内容の見直しや独自性の向上を検討してください。", 50, 0.65, "類似度65%以上+一致率10%以下+同講座 または 類似度65%以上+一致率15%以下+異講座", ["定期的な類似度チェック", "トラフィック動向の監視", "コンテンツ更新の検討", "将来的な統合可能性の評価"], "未定", None, []),
    ("MONITOR", "監視", "軽微な類似性があります。現時点では特別な対応は不要ですが、定期的な確認を継続してください。", 40, 0.60, "類似度60%以上", ["定期的な類似度チェック", "トラフィック動向の監視", "コンテンツ更新の検討", "将来的な統合可能性の評価"], "継続的", None, []),
]

ACTION_DDL = "recommendation_type string, name string, description string, action_priority int, min_similarity double, conditions string, steps array<string>, timeline string, recommended_similarity double, benefits array<string>"


def actions(spark: SparkSession) -> DataFrame:
    """The action dimension; sort by action_priority descending."""
    return spark.createDataFrame(ACTIONS, ACTION_DDL)


def rule(score: Column, ratio: Column, same: Column) -> Column:
    """Name of the first rule of the unified ladder that holds; a null ratio or course holds in none that asks for it."""
    r, s = F.coalesce(ratio, F.lit(0.0)), F.coalesce(same, F.lit(False))
    return (
        F.when((score >= 0.95) & (r >= 0.5), "merge_any").when((score >= 0.92) & (r >= 0.3) & s, "merge_same")
        .when(score >= 0.90, "redirect_any").when((score >= 0.88) & (r >= 0.2) & s, "redirect_ratio").when((score >= 0.85) & s, "redirect_same")
        .when((score >= 0.75) | ((score >= 0.70) & (r >= 0.15)), "cross_link")
        .when((score >= 0.65) & s & (r <= 0.1) & (r > 0), "review_same").when((score >= 0.65) & ~s & (r <= 0.15) & (r > 0), "review_other")
        .when(score >= 0.60, "monitor").otherwise("none")
    )


#: rule -> action, priority
RULES = {"merge_any": ("MERGE_CONTENT", 100), "merge_same": ("MERGE_CONTENT", 90), "redirect_any": ("REDIRECT_301", 85), "redirect_ratio": ("REDIRECT_301", 80), "redirect_same": ("REDIRECT_301", 70), "cross_link": ("CROSS_LINK", 60), "review_same": ("REVIEW", 50), "review_other": ("REVIEW", 45), "monitor": ("MONITOR", 40), "none": ("MONITOR", 0)}


def _of_rule(name: Column, i: int) -> Column:
    out = F.lit(None)
    for k, v in RULES.items():
        out = F.when(name == k, F.lit(v[i])).otherwise(out)
    return out


def unified(df: DataFrame, score: str = "score", ratio: str = "matching_ratio", same: str = "same_course") -> DataFrame:
    """df with rule, recommendation_type, priority and confidence_score."""
    named = df.withColumn("rule", rule(F.col(score), F.col(ratio), F.col(same)))
    return named.withColumns({"recommendation_type": _of_rule(F.col("rule"), 0), "priority": _of_rule(F.col("rule"), 1), "confidence_score": F.col(score) * 0.95 + 0.05})


# Explanation per rule; {0} similarity in percent, {1} ratio in percent, {2} matching sections, {3} note on the course, {4} advice on direction
EXPLANATIONS = {
    "merge_any": "📊 両記事の内容が極めて似ています（類似度{0}%）。記事の約{1}%（{2}個のセクション）で内容が重複しているため、統合することでSEO評価が向上します。{3} {4}",
    "merge_same": "📊 両記事の内容が非常に似ています（類似度{0}%）。{2}個のセクションで内容が重複しているため、記事を統合することで重複コンテンツを解消し、SEO評価を集約できます。",
    "redirect_any": "🔄 両記事の内容が非常に似ています（類似度{0}%）。{3} 301リダイレクトで{4}することで、SEO評価を1つの記事に集約できます。",
    "redirect_ratio": "🔄 両記事は似た内容を扱っています（類似度{0}%）。{2}個のセクションで内容が重なっているため、301リダイレクトで{4}することで、SEO評価を1つの記事に集約できます。",
    "redirect_same": "🔄 両記事の内容に類似性があります（類似度{0}%）。同じトピックを扱っているため、301リダイレクトでアクセスを集約し、SEO評価を向上させることができます。",
    "cross_link": "🔗 両記事は関連するトピックを扱っています（類似度{0}%）。それぞれの記事に相互リンクを設置することで、読者が関連情報にアクセスしやすくなり、サイト内の回遊性が向上します。{3}",
    "review_same": "👀 両記事には部分的な類似性があります（類似度{0}%）。わずか{2}個のセクションのみが重複しているため、内容を確認して、必要に応じて情報を差別化することをお勧めします。",
    "review_other": "👀 異なる講座ですが、部分的な類似性があります（類似度{0}%）。{2}個のセクションで重複が見られるため、内容の差別化や独自性の向上を検討してください。",
    "monitor": "📌 両記事には軽微な類似性があります（類似度{0}%）。{3} 今すぐのアクションは不要ですが、将来的に内容が重複しないよう、定期的に確認することをお勧めします。",
    "none": "部分的な類似性があります。コンテンツの重複を確認してください。",
}
# Notes on the course (same, other) and advice on direction (similar page first, base page first)
COURSE_NOTES = {
    "merge_any": ("同一講座内での統合です。", "⚠️ 異なる講座ですが、内容がほぼ同一のため統合を推奨します。"),
    "redirect_any": ("同一講座内でのリダイレクトです。", "⚠️ 異なる講座ですが、内容が非常に似ているためリダイレクトを推奨します。"),
    "cross_link": ("💡 同じ講座内の関連記事として、理解を深める助けになります。", "💡 異なる講座の関連記事として、ユーザーの学習範囲を広げることができます。"),
    "monitor": ("同一講座内での軽微な類似性です。", "異なる講座での軽微な類似性です。"),
}
MERGE_ADVICE = ("💡 アクセス数が多い類似記事（%d PV）に基点記事を統合すると、SEO効果が最大化されます。", "💡 アクセス数が多い基点記事（%d PV）に、この類似記事を統合することをお勧めします。")
REDIRECT_ADVICE = ("アクセス数の多い類似記事（%d PV）に転送", "アクセス数の多い基点記事（%d PV）に転送")


def explanation(score: Column, ratio: Column, same: Column, base_views: Column, similar_views: Column, matching: Column, name: Column) -> Column:
    """Text for the rule of this name, with its numbers."""
    views = [F.coalesce(c, F.lit(0)).cast("bigint") for c in (base_views, similar_views)]
    merge = F.when(views[1] > views[0], F.format_string(MERGE_ADVICE[0], views[1])).otherwise(F.format_string(MERGE_ADVICE[1], views[0]))
    redirect = F.when(views[1] > views[0] * 2, F.format_string(REDIRECT_ADVICE[0], views[1])).otherwise(F.format_string(REDIRECT_ADVICE[1], views[0]))
    out = F.lit(EXPLANATIONS["none"])
    for k, text in EXPLANATIONS.items():
        note = F.when(same, COURSE_NOTES[k][0]).otherwise(COURSE_NOTES[k][1]) if k in COURSE_NOTES else F.lit("")
        column = F.lit(text)
        for i, value in enumerate((F.format_string("%.1f", score * 100), F.format_string("%.0f", F.coalesce(ratio, F.lit(0.0)) * 100), F.coalesce(matching, F.lit(0)).cast("string"), note, merge if k == "merge_any" else redirect)):
            column = F.replace(column, F.lit(f"{{{i}}}"), value)
        out = F.when(name == k, column).otherwise(out)
    return out


def direction(base_id: Column, similar_id: Column, base_views: Column, similar_views: Column, action: Column) -> tuple[Column, Column]:
    """keep_id and drop_id for merges (more views) and redirects (more than twice as many), null for other actions."""
    b, s = F.coalesce(base_views, F.lit(0)), F.coalesce(similar_views, F.lit(0))
    other = ((action == "MERGE_CONTENT") & (s > b)) | ((action == "REDIRECT_301") & (s > 2 * b))
    acts = action.isin("MERGE_CONTENT", "REDIRECT_301")
    return F.when(acts, F.when(other, similar_id).otherwise(base_id)), F.when(acts, F.when(other, base_id).otherwise(similar_id))


def realtime(score: Column) -> Column:
    return F.when(score >= 0.94, "MERGE_CONTENT").when(score >= 0.80, "REDIRECT_301").when(score >= 0.70, "CROSS_LINK").otherwise("MONITOR")


def cached(score: Column) -> Column:
    return F.when(score >= 0.8, "MERGE_CONTENT").when(score >= 0.6, "REDIRECT_301").when(score >= 0.4, "CROSS_LINK").otherwise("MONITOR")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def traffic(base: Column, similar: Column, score: Column) -> dict[str, Column]:
    """Combined and predicted views, increase, its percentage, confidence level."""
    combined = F.coalesce(base, F.lit(0)) + F.coalesce(similar, F.lit(0))
    predicted = half_up(combined * (1 + score * 0.3))
    percent = F.when(combined > 0, half_up((predicted - combined) / combined * 100)).otherwise(F.lit(0))
    level = F.when(score > 0.7, "high").when(score > 0.5, "medium").otherwise("low")
    return {"current_combined_pv": combined, "predicted_pv": predicted, "expected_increase": predicted - combined, "increase_percentage": percent.cast("bigint"), "confidence_level": level}


def cache_traffic(base: Column, similar: Column, score: Column) -> Column:
    return ((F.coalesce(base, F.lit(0)) + F.coalesce(similar, F.lit(0))) * (1 + score * 0.2)).cast("bigint")


def keyword_overlap(base: Column, similar: Column) -> Column:
    """Base keywords that the other has in any case."""
    other = F.coalesce(similar, F.array().cast("array<string>"))
    return F.filter(F.coalesce(base, F.array().cast("array<string>")), lambda k: F.exists(other, lambda x: F.lower(x) == F.lower(k)))


def content_analysis(base_keywords: Column, similar_keywords: Column, base_text: Column, similar_text: Column) -> dict[str, Column]:
    common = keyword_overlap(base_keywords, similar_keywords)
    a, b = (F.char_length(F.coalesce(t, F.lit(""))) for t in (base_text, similar_text))
    n = F.coalesce(F.size(base_keywords), F.lit(0))
    advice = F.filter(F.array(
        F.when(F.size(common) > 3, "キーワードカニバリゼーションの可能性があります。統合を検討してください。"),
        F.when((a < 1000) & (b < 1000), "両記事とも短いため、統合により充実したコンテンツを作成できます。"),
        F.when(F.abs(a - b) > 2000, "コンテンツ量に大きな差があります。短い記事の内容を長い記事に統合することを検討してください。"),
    ), lambda x: x.isNotNull())
    return {
        "common_keywords": common, "overlap_percentage": F.when(n > 0, half_up(F.size(common) / n * 100)).otherwise(F.lit(0)).cast("bigint"), "cannibalization": F.size(common) > 3,
        "length_ratio": F.when(b > 0, half_up(a / b * 100) / 100).otherwise(F.lit(0.0)), "advice": advice,
    }


def integration_score(score: Column, base_views: Column, similar_views: Column, base_time: Column, similar_time: Column, increase: Column) -> Column:
    total = F.coalesce(base_views, F.lit(0)) + F.coalesce(similar_views, F.lit(0))
    mean = (F.coalesce(base_time, F.lit(0.0)) + F.coalesce(similar_time, F.lit(0.0))) / 2
    points = score * 100 + F.when(total > 1000, 10).otherwise(0) + F.when(total > 5000, 10).otherwise(0) + F.when(mean > 60, 5).otherwise(0) + F.when(increase > 20, 15).otherwise(0)
    return F.least(half_up(points), F.lit(100))


def pair_priority(points: Column, score: Column, predicted: Column) -> Column:
    return F.least(points + F.when(score > 0.8, 10).otherwise(0) + F.when(predicted > 10000, 15).otherwise(0), F.lit(100))


def risks(action: Column, base_views: Column, base_organic: Column, similar_organic: Column) -> Column:
    """Fixed sentences that apply, or the one that none does."""
    found = F.filter(F.array(
        F.when((action == "MERGE_CONTENT") & (base_views > 5000), "高トラフィック記事の統合によるSEOリスク"),
        F.when(action == "MERGE_CONTENT", "統合作業中の一時的な順位下落の可能性"),
        F.when(action == "REDIRECT_301", "リダイレクト実装時の技術的リスク"),
        F.when(action == "REDIRECT_301", "短期的なトラフィック減少の可能性"),
        F.when((base_organic > 1000) | (similar_organic > 1000), "オーガニック検索への影響"),
    ), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("リスクは低いと評価されます")))
