x348