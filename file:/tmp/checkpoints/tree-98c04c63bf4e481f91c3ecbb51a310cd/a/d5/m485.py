x485