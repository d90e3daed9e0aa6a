x881