x536