x921