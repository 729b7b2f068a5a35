"""Explicit schemas, as DDL, of raw records, signals and envelopes; nothing is inferred."""

REDDIT = "id string, title string, selftext string, subreddit string, author string, created_utc double, score long, num_comments long, upvote_ratio double, poll_priority string, last_polled_at double"
HACKERNEWS = "objectID string, title string, url string, author string, created_at_i long, points long, num_comments long, story_text string, _tags array<string>, dead boolean, deleted boolean"
BLUESKY = "uri string, cid string, author string, author_handle string, record struct<text:string,createdAt:string,langs:array<string>>, likeCount long, replyCount long, repostCount long, feed string, ingested_at double"
YOUTUBE = "id string, snippet struct<videoId:string,totalReplyCount:long,topLevelComment:struct<snippet:struct<textOriginal:string,authorDisplayName:string,publishedAt:string,likeCount:long>>>, video_title string, channel_id string, channel_title string"
ENVELOPE = "source_topic string, error string, failed_at timestamp, attempt int, payload string"
SIGNAL = (
    "id string, platform string, source_id string, title string, body string, url string, author string, community string, "
    "published_at timestamp, ingested_at timestamp, raw_score long, comment_count long, normalised_score double, score_velocity double, comment_velocity double, "
    "trending_score double, is_trending boolean, sentiment_compound double, sentiment_label string, keywords array<string>, topics array<string>, extra map<string,string>, schema_version int"
)
RAW = {"reddit": REDDIT, "hackernews": HACKERNEWS, "bluesky": BLUESKY, "youtube": YOUTUBE}
