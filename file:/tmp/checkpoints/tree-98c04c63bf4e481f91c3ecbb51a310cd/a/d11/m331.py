x331