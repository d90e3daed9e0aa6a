x612