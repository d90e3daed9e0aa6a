x358