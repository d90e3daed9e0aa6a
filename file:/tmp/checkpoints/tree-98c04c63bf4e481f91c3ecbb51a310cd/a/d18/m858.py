x858