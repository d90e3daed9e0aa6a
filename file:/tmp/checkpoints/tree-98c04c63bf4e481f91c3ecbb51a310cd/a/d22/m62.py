x62