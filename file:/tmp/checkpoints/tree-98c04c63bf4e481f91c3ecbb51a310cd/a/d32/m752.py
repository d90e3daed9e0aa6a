x752