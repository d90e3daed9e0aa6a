x557