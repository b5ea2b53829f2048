"""Table schemas."""

from pyspark.sql import types as T

S, L, D, TS, B = T.StringType(), T.LongType(), T.DateType(), T.TimestampType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


#: Landed post as written by a collector: dates are still text.
RAW_POST = _struct(
    text=S, raw_text=S, title=S, source=S, url=S, username=S, post_date=S, _logged_date=S, subreddit=S, forum_section=S,
    search_term=S, score=L, like_count=L, repost_count=L, num_comments=L, post_id=S, hash=S, competitor=S, competitor_type=S,
    topic_focus=T.ArrayType(S), mentions_competitor=T.ArrayType(S), mentions_ecosystem_partner=T.ArrayType(S), _corrupt_record=S)

#: Canonical post.
POST = _struct(
    post_id=S, text=S, title=S, source=S, url=S, username=S, post_date=D, logged_at=TS, subreddit=S, forum_section=S, search_term=S,
    score=L, like_count=L, repost_count=L, num_comments=L, competitor=S, competitor_type=S)

#: Append log of insights.
TREND_LOG = _struct(text=S, topic=S, target_brand=S, brand_sentiment=S, pm_priority_score=T.DoubleType(), _trend_keywords=T.ArrayType(S),
                    _trend_score=L, _logged_at=S)

FEED_ITEM = _struct(title=S, link=S, description=S, pubDate=S, published=S, category=T.ArrayType(S), **{
    "content:encoded": S, "dc:creator": S, "dc:date": S, "itunes:summary": S, "itunes:duration": S,
    "summary": S, "author": _struct(name=S), "enclosure": _struct(_url=S)})

_LISTING_POST = _struct(
    title=S, selftext=S, body=S, author=S, permalink=S, id=S, parent_id=S, link_title=S, subreddit=S, created_utc=T.DoubleType(), score=L,
    num_comments=L, upvote_ratio=T.DoubleType(), is_self=B, link_flair_text=S, post_hint=S, url=S, thumbnail=S,
    preview=_struct(images=T.ArrayType(_struct(source=_struct(url=S)))))
LISTING = _struct(data=_struct(children=T.ArrayType(_struct(kind=S, data=_LISTING_POST))))

FORUM_ITEM = _struct(subject=S, body=S, author=_struct(login=S), post_time=S, board=_struct(id=S), view_href=S, metrics=_struct(views=L), depth=L)
