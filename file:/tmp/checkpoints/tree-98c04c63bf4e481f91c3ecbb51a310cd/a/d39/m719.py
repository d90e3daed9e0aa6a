x719