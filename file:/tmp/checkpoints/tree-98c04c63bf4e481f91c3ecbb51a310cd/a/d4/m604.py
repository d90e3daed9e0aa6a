x604