"""Shapes of the documents that are read (§1.3)."""

from __future__ import annotations

COMMENT = "struct<contentHtml:string,contentMarkdown:string,authorName:string,createdTime:bigint>"
ANSWER = (
    f"struct<id:string,author:string,url:string,content:string,excerpt:string,voteupCount:bigint,commentCount:bigint,createdTime:bigint,updatedTime:bigint,comments:array<{COMMENT}>>"
)
QUESTION_DOC = (
    "questionId string, questionTitle string, answerCount bigint, url string, fetchedAt string, failed boolean,"
    f"question struct<id:string,title:string,descriptionHtml:string,topics:array<struct<id:string,name:string>>>, answers array<{ANSWER}>"
)
CHUNK = (
    "chunkId string, sourceIds array<string>, sources array<struct<sourceId:string,questionId:string,answerId:string,author:string,relativePath:string,voteupCount:bigint>>,"
    "text string, chars bigint, estimatedTokens struct<min:bigint,max:bigint>, chunkHash string, status string"
)
MAP_RESULT = (
    "chunkId string, chunkHash string, sourceIds array<string>, summary string, claims array<struct<claim:string,evidenceSourceIds:array<string>,confidence:string>>,"
    "themes array<string>, uncertainties array<string>, minorityViews array<string>, sourceCoverage array<struct<sourceId:string,summary:string,disposition:string>>"
)
PAGE = "question_id string, page long, offset long, is_end boolean, answers array<struct<id:string,author:string,content:string,excerpt:string,voteup_count:bigint,comment_count:bigint,created_time:bigint,updated_time:bigint>>"
